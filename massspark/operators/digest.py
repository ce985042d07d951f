"""Digestion of proteins into peptides, decoys and composition, as relational operators.

proteins: accession, sequence (upper case), and optionally description and is_decoy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massspark.functions.chem import RESIDUES, is_standard, let, letters
from massspark.operators.arrow import byte_view, mapped, slices, strings

#: Bytes of sequences that a task digests at once (a longer one alone), and starts of peptides that make a batch.
TEXT_BYTES, STARTS = 1 << 20, 1 << 15


@dataclass(frozen=True)
class Enzyme:
    """Cleaves beside the residues of cleave_at (none: anywhere): after them, or before them if c_term is false."""

    name: str
    cleave_at: str
    c_term: bool = True
    description: str = ""

    @classmethod
    def parse(cls, spec: str) -> Enzyme:
        """A number or name of ENZYMES, or `Name,Residues,Terminus[,Description]` with `null` for no residues."""
        spec = spec.strip()
        if "," not in spec:
            found = [e for i, e in enumerate(ENZYMES) if spec == str(i) or spec.lower() == e.name.lower()]
            if not found:
                raise ValueError(f"unknown enzyme `{spec}`: a number up to {len(ENZYMES) - 1}, a name or a definition")
            return found[0]
        fields = [x.strip() for x in spec.split(",", 3)]
        if len(fields) < 3:
            raise ValueError(f"enzyme `{spec}`: expected Name,Residues,Terminus[,Description]")
        cleave_at = "" if fields[1].lower() in ("", "null") else fields[1]
        if not all("A" <= c <= "Z" for c in cleave_at):
            raise ValueError(f"enzyme `{fields[0]}`: residues must be upper-case letters")
        if fields[2].upper() not in ("C", "N"):
            raise ValueError(f"enzyme `{fields[0]}`: the terminus is C or N, not `{fields[2]}`")
        return cls(fields[0], cleave_at, fields[2].upper() == "C", fields[3] if len(fields) > 3 else "")


# The built-in enzymes by number.
ENZYMES = (
    Enzyme("UnspecificCleavage", "", True, "unspecific cleavage"), Enzyme("Tryp", "KR", True, "Trypsin"),
    Enzyme("Chymotrypsin", "FYWL", True, "Chymotrypsin"), Enzyme("LysC", "K", True, "Lys-C"),
    Enzyme("LysN", "K", False, "Lys-N"), Enzyme("GluC", "E", True, "glutamyl endopeptidase"),
    Enzyme("ArgC", "R", True, "Arg-C"), Enzyme("AspN", "D", False, "Asp-N"), Enzyme("aLP", "", True, "alphaLP"),
    Enzyme("NoCleavage", "", True, "no cleavage (endogenous peptides)"), Enzyme("TrypPlusC", "KRC", True, "Cleave after K, R, or C"),
)
TRYPSIN = ENZYMES[1]


@dataclass(frozen=True)
class Digest:
    enzyme: Enzyme = TRYPSIN
    max_missed: int | None = None
    min_len: int = 6
    max_len: int = 40
    min_termini: int = 2
    cleave_initiator_met: bool = True


def digest(proteins: DataFrame, params: Digest = Digest()) -> DataFrame:
    """accession, start, len, n_termini, peptide, pre, post, prot_n, prot_c of every peptide of standard residues."""
    if not params.enzyme.cleave_at or params.min_termini < 2:
        return _substrings(proteins, params)
    return _full(proteins, params)


def _flagged(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(letters.encode(), np.uint8)] = True
    return out


def _full(proteins: DataFrame, params: Digest) -> DataFrame:
    """Runs of pieces between cuts: each piece with those after it that still fit the length.

    A task works on the bytes of a batch of whole sequences, in work linear in them: no shuffle, and accessions may repeat.
    """
    most = params.max_len if params.max_missed is None else min(params.max_missed + 1, params.max_len)
    cleaved, standard, c_term, met = _flagged(params.enzyme.cleave_at), _flagged(RESIDUES), params.enzyme.c_term, params.cleave_initiator_met

    def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start, and the end of all: cuts inside and the ends of sequences. The one behind a leading M counts as inside."""
        cut = np.zeros(len(data) + 1, bool)
        cut[c_term : len(data) + c_term] = cleaved[data]
        cut[offsets] = True
        if met:
            cut[offsets[:-1][data[offsets[:-1]] == ord("M")] + 1] = True
        return np.flatnonzero(cut)

    def before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bytes of the letter that ends there."""
        size = np.ones(len(at), np.int64)
        for _ in range(3):
            size += data[at - size] & 0xC0 == 0x80
        return size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sequence", TEXT_BYTES):
            data, offsets = byte_view(batch.column("sequence"))
            at = pieces(data, offsets)
            row = np.searchsorted(offsets, at[:-1], "right") - 1
            edges = np.searchsorted(at, offsets)
            place = np.r_[0, np.cumsum(np.add.reduceat(data & 0xC0 != 0x80, at[:-1], dtype=np.int64))]  # in letters
            bad = np.r_[0, np.cumsum(np.add.reduceat(~standard[data], at[:-1], dtype=np.int64))]
            padded = np.r_[data, np.frombuffer(b"-", np.uint8)]
            for low in range(0, len(row), STARTS):
                first, found = np.arange(low, min(low + STARTS, len(row))), []
                for k in range(1, most + 1):
                    first = first[first + k <= edges[row[first] + 1]]
                    n = place[first + k] - place[first]
                    first, n = first[n <= params.max_len], n[n <= params.max_len]
                    good = first[(n >= params.min_len) & (bad[first + k] == bad[first])]
                    found.append((good, good + k))
                s, e = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(s):
                    continue
                own, start, end = row[s], at[s], at[e]
                prot_n, prot_c = s == edges[own], e == edges[own + 1]
                back = before(data, start)
                ahead = padded[end]
                wide = 1 + (ahead >= 0xC0).astype(np.int64) + (ahead >= 0xE0) + (ahead >= 0xF0)
                columns = [
                    batch.column("accession").take(pa.array(own)), pa.array((place[s] - place[edges[own]]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(np.full(len(s), 2, np.int32)),
                    strings(data, start, end - start), strings(padded, np.where(prot_n, len(data), start - back), np.where(prot_n, 1, back)), strings(padded, np.where(prot_c, len(data), end), np.where(prot_c, 1, wide)),
                    pa.array(prot_n), pa.array(prot_c),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [("start", "int"), ("len", "int"), ("n_termini", "int"), ("peptide", "string"), ("pre", "string"), ("post", "string"), ("prot_n", "boolean"), ("prot_c", "boolean")]
    names = ["accession", *(n for n, _ in kinds)]
    schema = f"accession {proteins.schema['accession'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in kinds)
    return mapped(proteins.where(F.length("sequence") > 0).select("accession", "sequence"), run, schema)


def _substrings(proteins: DataFrame, params: Digest) -> DataFrame:
    """Every span, or with an enzyme those with enough ends at cuts: each start with the residues that a span from it can reach.

    Cuts up to and with the end count as missed, one more than the limit stops.
    """
    e = params.enzyme

    def starts(residues: Column) -> Column:
        n = F.size(residues)
        at = F.when(n >= params.min_len, F.sequence(F.lit(0), n - params.min_len)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("start"), F.coalesce(F.get(residues, i - 1), F.lit("-")).alias("pre"), F.array_join(F.slice(residues, i + 1, params.max_len + 1), "").alias("ahead"), (n - i).alias("left")))

    rows = proteins.where(F.length("sequence") > 0).select("accession", F.explode(let(letters(F.col("sequence")), starts)).alias("x")).select("accession", "x.*")
    rows = rows.select("*", F.explode(F.sequence(F.lit(params.min_len), F.least(F.lit(params.max_len), F.col("left")))).alias("len"))
    rows = rows.withColumns({"peptide": F.expr("substring(ahead, 1, len)"), "prot_n": F.col("start") == 0, "prot_c": F.col("len") == F.col("left")})
    rows = rows.withColumn("post", F.when(F.col("prot_c"), "-").otherwise(F.expr("substring(ahead, len + 1, 1)")))
    if e.cleave_at:
        cleaved = lambda x: F.contains(F.lit(e.cleave_at), x)
        many = lambda x: F.length(x) - F.length(F.translate(x, e.cleave_at, ""))
        first, last, met = F.substring("ahead", 1, 1), F.substring("peptide", -1, 1), F.lit(params.cleave_initiator_met)
        left = F.col("prot_n") | cleaved(F.col("pre") if e.c_term else first) | (met & (F.col("start") == 1) & (F.col("pre") == "M"))
        initiator = met & F.col("prot_n") & (first == "M") & (F.col("left") > 1)
        right = F.col("prot_c") | cleaved(last if e.c_term else F.col("post")) | (initiator & (F.col("len") == 1))
        inside = many(F.col("peptide")) - (F.col("prot_c") & cleaved(last)).cast("int") if e.c_term else many(F.expr("substring(ahead, 2, len)"))
        inside = inside + (initiator & ~cleaved(F.lit("M") if e.c_term else F.substring("ahead", 2, 1))).cast("int")
        rows = rows.withColumn("n_termini", left.cast("int") + right.cast("int")).where(F.col("n_termini") >= params.min_termini)
        rows = rows if params.max_missed is None else rows.where(inside <= params.max_missed + 1)
    else:
        rows = rows.withColumn("n_termini", F.lit(2))
    return rows.where(is_standard(F.col("peptide"))).select("accession", "start", "len", "n_termini", "peptide", "pre", "post", "prot_n", "prot_c")


def with_decoys(proteins: DataFrame, prefix: str = "XXX_") -> DataFrame:
    """The proteins and, unless some are decoys already, each one reversed under prefix + accession."""
    if not proteins.where("is_decoy").isEmpty():
        return proteins
    changed = {"accession": F.concat(F.lit(prefix), "accession"), "sequence": F.reverse("sequence"), "is_decoy": F.lit(True)}
    return proteins.unionByName(proteins.withColumns(changed))


def decoy_sanity(proteins: DataFrame) -> DataFrame:
    """proteins, distinct accessions, decoys, and if the database looks sound (half distinct, 40 to 60 % decoys)."""
    n, distinct, decoys = F.count("*"), F.count_distinct("accession"), F.count_if("is_decoy")
    return proteins.agg(n.alias("proteins"), distinct.alias("accessions"), decoys.alias("decoys")).withColumn("sound", (F.col("accessions") >= 0.5 * F.col("proteins")) & (F.col("decoys") / F.col("proteins")).between(0.4, 0.6))


def composition(proteins: DataFrame) -> DataFrame:
    """residue, n, frequency over the target proteins' standard residues; 0.05 each where there are none."""
    targets = proteins.where(~F.col("is_decoy")) if "is_decoy" in proteins.columns else proteins
    counts = targets.agg(*[F.coalesce(F.sum(F.length("sequence") - F.length(F.replace("sequence", F.lit(r), F.lit("")))), F.lit(0)).alias(r) for r in RESIDUES])
    total = sum(F.col(r) for r in RESIDUES)
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("residue"), F.col(r).alias("n"), total.alias("total")) for r in RESIDUES])).alias("x")).select("x.*")
    return rows.select("residue", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.05).alias("frequency"))
