"""Named queries over the driver's tables, one per operator, with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massspark.functions import chem
from massspark.functions import distributions as dist
from massspark.operators import digest as dig
from massspark.operators import fdr as fd
from massspark.operators import matching as ma
from massspark.operators import staging
from massspark.operators.mass_index import build_index
from massspark.plans.adaptors import MATCHES_SQL, PEAKS_SQL, PROTEINS_SQL, SHORT_PROTEINS_SQL, annotated, matches, model, peaks, proteins, short_proteins, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


MASS_LIST = ", ".join(f"('{r}', {m!r}::DOUBLE)" for r, m in chem.MASSES.items())
_STANDARD = f"regexp_matches(peptide, '^[{chem.RESIDUES}]+$')"


def _digest_sql(source: str, cut: str, missed: int) -> str:
    """Full digestion: pieces by a split, runs of pieces by a window's list."""
    return f"""WITH p AS (SELECT *, row_number() OVER () AS row FROM ({source})),
f AS (SELECT row, accession, [x FOR x IN string_split(regexp_replace({cut}, '^M([^|])', 'M|\\1'), '|') IF x <> ''] AS f FROM p),
u AS (SELECT row, accession, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS piece FROM f),
w AS (SELECT accession, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  list(piece) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {missed + 1} FOLLOWING) AS run, lag(piece) OVER (PARTITION BY row ORDER BY i) AS before FROM u),
s AS (SELECT accession, CAST(start AS INTEGER) AS start, array_to_string(run[1:k], '') AS peptide, before, run[k + 1] AS after
  FROM w, (SELECT unnest(range(1, {missed + 2})) AS k) WHERE k <= len(run))
SELECT accession, start, CAST(length(peptide) AS INTEGER) AS len, 2::INTEGER AS n_termini, peptide, coalesce(right(before, 1), '-') AS pre, coalesce(left(after, 1), '-') AS post,
  before IS NULL AS prot_n, after IS NULL AS prot_c FROM s WHERE length(peptide) BETWEEN 6 AND 40 AND {_STANDARD}"""


_TRYPTIC = "regexp_replace(sequence, '([KR])', '\\1|', 'g')"
PEPTIDES_SQL = _digest_sql(PROTEINS_SQL, _TRYPTIC, 2)


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dig.digest(proteins(spark, sf_dir), dig.Digest(max_missed=2))


@query(f"SELECT accession, length(sequence) AS n, md5(sequence) AS md5 FROM ({PROTEINS_SQL})")
def scan_proteins(spark, sf_dir):
    return proteins(spark, sf_dir).select("accession", F.length("sequence").alias("n"), F.md5("sequence").alias("md5"))


@query(f"""WITH p AS ({PROTEINS_SQL}), n AS (SELECT r AS residue, coalesce(sum(length(sequence) - length(replace(sequence, r, ''))), 0)::BIGINT AS n
  FROM (SELECT unnest(string_split('{','.join(chem.RESIDUES)}', ',')) AS r) LEFT JOIN p ON true GROUP BY r)
SELECT residue, n, round(n / sum(n) OVER (), 9) AS frequency FROM n""")
def aa_composition(spark, sf_dir):
    return dig.composition(proteins(spark, sf_dir)).withColumn("frequency", F.round("frequency", 9))


@query(f"""WITH m(residue, mass) AS (VALUES {MASS_LIST}), d AS (SELECT DISTINCT peptide FROM ({PEPTIDES_SQL})),
r AS (SELECT peptide, unnest(string_split(peptide, '')) AS residue FROM d),
x AS (SELECT peptide, sum(mass) + {chem.WATER!r} AS mass FROM r JOIN m USING (residue) GROUP BY peptide)
SELECT peptide, round(mass, 6) AS mass, round((mass + 2 * {chem.PROTON}) / 2, 6) AS mz2 FROM x""")
def peptide_mass(spark, sf_dir):
    mass = chem.neutral_mass(F.col("peptide"))
    return peptides(spark, sf_dir).select("peptide").distinct().select("peptide", F.round(mass, 6).alias("mass"), F.round(chem.mz(mass, 2), 6).alias("mz2"))


@query(f"""SELECT spec_index, l_linenumber, cents, CAST(round(CAST(CAST(mz AS FLOAT) * CAST(0.999497 AS FLOAT) AS FLOAT)) AS INTEGER) AS nominal,
  CAST(floor(CAST(mz AS FLOAT) / CAST(7 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS half_up FROM ({PEAKS_SQL})""")
def nominal_bins(spark, sf_dir):
    p = peaks(spark, sf_dir)
    return p.select("spec_index", "l_linenumber", "cents", chem.nominal_bin(F.col("mz")).alias("nominal"), chem.round_half_up((F.col("mz").cast("float") / F.lit(7).cast("float")).cast("float")).alias("half_up"))


@query(_digest_sql(PROTEINS_SQL, _TRYPTIC, 0))
def digest_tryptic_mc0(spark, sf_dir):
    return dig.digest(proteins(spark, sf_dir), dig.Digest(max_missed=0))


@query(_digest_sql(PROTEINS_SQL, _TRYPTIC, 2))
def digest_tryptic_mc2(spark, sf_dir):
    return dig.digest(proteins(spark, sf_dir), dig.Digest(max_missed=2))


@query(_digest_sql(PROTEINS_SQL, "regexp_replace(sequence, '([D])', '|\\1', 'g')", 1))
def digest_nterm_enzyme(spark, sf_dir):
    return dig.digest(proteins(spark, sf_dir), dig.Digest(dig.Enzyme.parse("AspN"), max_missed=1))


_REPEATED_SQL = PROTEINS_SQL.replace("'D' || doc_id", "'L' || coalesce(lang, '')")


@query(_digest_sql(_REPEATED_SQL, _TRYPTIC, 1))
def digest_repeated_accessions(spark, sf_dir):
    """All documents of a language under one accession."""
    rows = proteins(spark, sf_dir, F.concat(F.lit("L"), F.coalesce("lang", F.lit(""))))
    return dig.digest(rows, dig.Digest(max_missed=1))


_SPANS = f"""WITH p AS ({SHORT_PROTEINS_SQL}), s AS (SELECT accession, sequence, CAST(unnest(range(0, length(sequence))) AS INTEGER) AS start FROM p),
l AS (SELECT accession, sequence, start, CAST(unnest(range(6, least(40, length(sequence) - start) + 1)) AS INTEGER) AS len FROM s),
e AS (SELECT *, substr(sequence, start + 1, len) AS peptide FROM l)"""
_SHAPE = """peptide, CASE WHEN start = 0 THEN '-' ELSE substr(sequence, start, 1) END AS pre,
  CASE WHEN start + len = length(sequence) THEN '-' ELSE substr(sequence, start + len + 1, 1) END AS post, start = 0 AS prot_n, start + len = length(sequence) AS prot_c"""


@query(f"{_SPANS} SELECT accession, start, len, 2::INTEGER AS n_termini, {_SHAPE} FROM e WHERE {_STANDARD}")
def digest_unspecific(spark, sf_dir):
    return dig.digest(short_proteins(spark, sf_dir), dig.Digest(dig.ENZYMES[0]))


_AT_CUT = "CASE WHEN {x} = 0 OR {x} = length(sequence) OR substr(sequence, {x}, 1) IN ('K', 'R') OR ({x} = 1 AND left(sequence, 1) = 'M') THEN 1 ELSE 0 END"
_INNER = "len([c FOR c IN range(start + 1, least(start + len + 1, length(sequence))) IF substr(sequence, c, 1) IN ('K', 'R') OR (c = 1 AND left(sequence, 1) = 'M')])"


@query(f"""{_SPANS}, t AS (SELECT *, CAST({_AT_CUT.format(x='start')} + {_AT_CUT.format(x='(start + len)')} AS INTEGER) AS n_termini, {_INNER} AS inner_cuts FROM e)
SELECT accession, start, len, n_termini, {_SHAPE} FROM t WHERE n_termini >= 1 AND inner_cuts <= 2 AND {_STANDARD}""")
def digest_semi(spark, sf_dir):
    return dig.digest(short_proteins(spark, sf_dir), dig.Digest(max_missed=1, min_termini=1))


@query(f"WITH p AS ({PROTEINS_SQL}) SELECT accession, md5(sequence) AS md5, false AS is_decoy FROM p UNION ALL SELECT 'XXX_' || accession, md5(reverse(sequence)), true FROM p")
def decoy_reverse(spark, sf_dir):
    return dig.with_decoys(proteins(spark, sf_dir)).select("accession", F.md5("sequence").alias("md5"), "is_decoy")


@query(f"WITH p AS ({PROTEINS_SQL}) SELECT 2 * count(*) AS proteins, 2 * count(DISTINCT accession) AS accessions, count(*) AS decoys, true AS sound FROM p")
def decoy_union_sanity(spark, sf_dir):
    return dig.decoy_sanity(dig.with_decoys(proteins(spark, sf_dir)))


def _ladder_sql(suffix: bool) -> str:
    return f"""WITH m(residue, mass) AS (VALUES {MASS_LIST}), d AS (SELECT DISTINCT peptide FROM ({PEPTIDES_SQL})),
r AS (SELECT peptide, CAST(unnest(range(1, length(peptide) + 1)) AS INTEGER) AS i, unnest(string_split({'reverse(peptide)' if suffix else 'peptide'}, '')) AS residue FROM d),
s AS (SELECT peptide, i, {chem.WATER if suffix else 0.0!r} + sum(mass) OVER (PARTITION BY peptide ORDER BY i) AS mass FROM r JOIN m USING (residue))
SELECT peptide, i, round(mass + {chem.PROTON}, 5) AS mz1, round((mass + 2 * {chem.PROTON}) / 2, 5) AS mz2 FROM s WHERE i < length(peptide)"""


def _ladder(spark, sf_dir, suffix):
    rows = ma.ladder(peptides(spark, sf_dir).select("peptide").distinct(), suffix)
    return rows.withColumns({"mz1": F.round("mz1", 5), "mz2": F.round("mz2", 5)})


@query(_ladder_sql(False))
def fragment_b(spark, sf_dir):
    return _ladder(spark, sf_dir, False)


@query(_ladder_sql(True))
def fragment_y(spark, sf_dir):
    return _ladder(spark, sf_dir, True)


_MODS = ma.Mods.parse("NumMods=2\nC2H3N1O1,C,fix,any,Carbamidomethyl\nO1,M,opt,any,Oxidation\nC2H2O1,*,opt,N-term,Acetyl\n")
_C, _O, _A = (m.mass for m in _MODS.mods)


@query(f"""WITH m(residue, mass) AS (VALUES {MASS_LIST}), d AS (SELECT DISTINCT peptide FROM ({PEPTIDES_SQL})),
r AS (SELECT peptide, unnest(string_split(peptide, '')) AS residue FROM d)
SELECT peptide, round(sum(mass) + {chem.WATER!r} + {_C!r} * count(*) FILTER (residue = 'C'), 6) AS mass FROM r JOIN m USING (residue) GROUP BY peptide""")
def fixed_mod_mass(spark, sf_dir):
    plain = ma.Mods(tuple(m for m in _MODS.mods if m.fixed))
    return ma.candidates(peptides(spark, sf_dir).dropDuplicates(["peptide"]), plain).select("peptide", F.round("mass", 6).alias("mass"))


@query(f"""WITH d AS (SELECT DISTINCT peptide FROM ({PEPTIDES_SQL})),
o AS (SELECT peptide, CAST(unnest(range(0, length(peptide))) AS INTEGER) AS pos FROM d),
s AS (SELECT peptide, pos, 1 AS mod, {_O!r} AS mass FROM o WHERE substr(peptide, pos + 1, 1) = 'M' UNION ALL SELECT peptide, 0, 2, {_A!r} FROM d),
x AS (SELECT peptide, '' AS placed, CAST(0 AS DOUBLE) AS delta FROM d
  UNION ALL SELECT peptide, pos || ':' || mod, mass FROM s
  UNION ALL SELECT a.peptide, a.pos || ':' || a.mod || ',' || b.pos || ':' || b.mod, a.mass + b.mass FROM s a JOIN s b USING (peptide) WHERE a.pos <> b.pos AND (a.mod, a.pos) < (b.mod, b.pos))
SELECT peptide, placed, round(delta, 6) AS delta FROM x""")
def var_mod_placements(spark, sf_dir):
    forms = ma.placements(peptides(spark, sf_dir).dropDuplicates(["peptide"]), _MODS)
    placed = F.array_join(F.transform("placement", lambda s: F.concat_ws(":", s["pos"].cast("string"), s["mod"].cast("string"))), ",")
    return forms.select("peptide", placed.alias("placed"), F.round("delta", 6).alias("delta"))


_ISOTOPE_MILLI = 1003


def _windows(spark, sf_dir):
    """Orders as precursors and parts as candidates, in whole thousandths."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_index"), F.round(F.col("o_totalprice") * 10).cast("bigint").alias("mass"))
    rows = o.select("spec_index", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("isotope"), "mass").withColumn("target", F.col("mass") - F.col("isotope") * _ISOTOPE_MILLI)
    return rows.withColumns({"low": F.col("target") - 50, "high": F.col("target") + 50})


_WINDOWS_SQL = f"""SELECT o_orderkey AS spec_index, isotope, target, target - 50 AS low, target + 50 AS high FROM
  (SELECT o_orderkey, k::INTEGER AS isotope, CAST(round(o_totalprice * 10) AS BIGINT) - k * {_ISOTOPE_MILLI} AS target FROM orders, (SELECT unnest([0, 1]) AS k))"""


@query(_WINDOWS_SQL)
def isotope_expand(spark, sf_dir):
    return _windows(spark, sf_dir).drop("mass")


@query(f"SELECT spec_index, isotope, p_partkey FROM ({_WINDOWS_SQL}) JOIN (SELECT p_partkey, CAST(round(p_retailprice * 1000) AS BIGINT) AS mass FROM part) ON mass BETWEEN low AND high")
def candidate_window_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 1000).cast("bigint").alias("mass"))
    return ma.range_join(_windows(spark, sf_dir).drop("mass"), parts, "low", "high", "mass", 100).select("spec_index", "isotope", "p_partkey")


@query(ORACLE_SQL["candidate_window_join"])
def candidate_index_join(spark, sf_dir):
    """The same by a mass-ordered index, written in ranges and swept."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 1000).cast("bigint").alias("mass"))
    index = build_index(parts, f"{staging.shared_dir(spark)}/mass-index-{uuid.uuid4().hex}", "mass")
    return index.matches(_windows(spark, sf_dir).drop("mass"), "low", "high").select("spec_index", "isotope", "p_partkey")


_TIES = ["l_partkey", "l_suppkey", "cents", "l_linenumber", "l_shipdate"]


@query(f"SELECT spec_index, mz, intensity, l_partkey, row_number() OVER (PARTITION BY spec_index ORDER BY intensity DESC, mz DESC, {', '.join(_TIES)})::INTEGER AS rank FROM ({PEAKS_SQL})")
def peak_rank(spark, sf_dir):
    return ma.ranked_peaks(peaks(spark, sf_dir), _TIES).select("spec_index", "mz", "intensity", "l_partkey", "rank")


@query(f"""WITH p AS ({PEAKS_SQL}), o AS (SELECT o_orderkey, 10000 + CAST(round(o_totalprice * 100) AS BIGINT) % 150000 AS precursor FROM orders)
SELECT spec_index, mz, l_linenumber, cents, CASE WHEN abs(mz - precursor) <= 2000 OR abs(mz - precursor // 2) <= 2000 THEN 0.0 ELSE intensity END AS intensity FROM p JOIN o ON spec_index = o_orderkey""")
def precursor_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_index"), (10000 + F.round(F.col("o_totalprice") * 100).cast("bigint") % 150000).alias("precursor"))
    near = (F.abs(F.col("mz") - F.col("precursor")) <= 2000) | (F.abs(F.col("mz") - F.floor(F.col("precursor") / 2)) <= 2000)
    return peaks(spark, sf_dir).join(o, "spec_index").select("spec_index", "mz", "l_linenumber", "cents", F.when(near, 0.0).otherwise(F.col("intensity")).alias("intensity"))


@query(f"""WITH p AS ({PEAKS_SQL}), t AS (SELECT o_orderkey AS spec_index, ion::INTEGER AS ion, 10000 + (ion * 14000) AS centre FROM orders, (SELECT unnest(range(0, 11)) AS ion)),
r AS (SELECT t.spec_index, ion, mz, intensity, row_number() OVER (PARTITION BY t.spec_index, ion ORDER BY intensity DESC, mz DESC) AS rn FROM t JOIN p ON p.spec_index = t.spec_index AND mz BETWEEN centre - 3000 AND centre + 3000)
SELECT spec_index, ion, mz, intensity FROM r WHERE rn = 1""")
def peak_match_argmax(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_index"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("ion"))
    centre = 10000 + F.col("ion") * 14000
    return ma.strongest_match(orders.withColumns({"low": centre - 3000, "high": centre + 3000}), peaks(spark, sf_dir), 6000)


@query("""WITH t AS (SELECT c_nationkey AS k, c_acctbal AS at, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2)
SELECT s_suppkey, s_acctbal, t.at AS floor_at, t.c_custkey FROM supplier ASOF LEFT JOIN t ON s_nationkey = t.k AND s_acctbal >= t.at""")
def partition_floor_join(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("at")).agg(F.min("c_custkey").alias("c_custkey"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("at"), "s_acctbal")
    return staging.floor_join(rows, keys, ["k"], "at", ["c_custkey"]).select("s_suppkey", "s_acctbal", "floor_at", "c_custkey")


@query(f"SELECT spec_index, mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY spec_index ORDER BY intensity DESC, mz DESC, {', '.join(_TIES)}) AS rn FROM ({PEAKS_SQL})) WHERE rn <= 2")
def topn_per_spectrum(spark, sf_dir):
    return ma.top_hits(peaks(spark, sf_dir), 2, ["spec_index"], [F.desc("intensity"), F.desc("mz"), *_TIES]).select("spec_index", "mz", "intensity")


@query(f"SELECT score, peptide, is_decoy, list_sort(list(protein)) AS proteins FROM ({MATCHES_SQL}) GROUP BY ALL")
def protein_rollup(spark, sf_dir):
    return fd.rolled_up(matches(spark, sf_dir).drop("match_id"))


@query(f"SELECT peptide, count(*) AS n, bool_and(starts_with(protein, 'XXX_')) AS is_decoy FROM ({MATCHES_SQL}) GROUP BY peptide")
def is_decoy_all(spark, sf_dir):
    m = matches(spark, sf_dir)
    return m.groupBy("peptide").agg(F.count("*").alias("n"), F.collect_set("protein").alias("p")).select("peptide", "n", chem.is_decoy_match(F.col("p"), "XXX_").alias("is_decoy"))


QMAP_SQL = """{n}_c AS (SELECT score, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM {src} GROUP BY score),
{n}_b AS (SELECT score, d, (sum(t) OVER w) - t AS tb, (sum(d) OVER w) - d AS db, sum(d) OVER () AS nd FROM {n}_c WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{n}_r AS (SELECT *, CASE WHEN d > 0 AND tb > 0 THEN CASE WHEN tb <= db THEN CAST(1 AS FLOAT) ELSE CAST(CAST(db AS FLOAT) / CAST(tb AS FLOAT) AS FLOAT) END END AS rate FROM {n}_b),
{n}_s AS (SELECT *, CASE WHEN coalesce(sum(CASE WHEN rate >= 1 THEN 1 ELSE 0 END) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN NULL ELSE rate END AS used FROM {n}_r),
{n} AS (SELECT score, least(coalesce(min(used) OVER (ORDER BY score ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), CAST(CASE WHEN nd = 0 THEN 0 ELSE 1 END AS FLOAT)), CAST(CASE WHEN nd = 0 THEN 0 ELSE 1 END AS FLOAT)) AS q FROM {n}_s)"""
FDR_SQL = f"""WITH m AS ({MATCHES_SQL}), best AS (SELECT peptide, is_decoy, min(score) AS score FROM m GROUP BY 1, 2),
pep AS (SELECT peptide, coalesce(min(score) FILTER (NOT is_decoy), min(score)) AS best FROM best GROUP BY 1),
{QMAP_SQL.format(n='psm_q', src='m')}, {QMAP_SQL.format(n='pep_q', src='best')},
z AS (SELECT match_id, m.score, m.peptide, m.is_decoy, psm_q.q AS q_value, pep_q.q AS pep_q_value FROM m JOIN psm_q ON psm_q.score = m.score JOIN pep USING (peptide) JOIN pep_q ON pep_q.score = pep.best)"""


@query(f"{FDR_SQL} SELECT match_id, q_value FROM z")
def psm_qvalue(spark, sf_dir):
    return fd.assign_q_values(matches(spark, sf_dir)).select("match_id", "q_value")


@query(f"{FDR_SQL} SELECT match_id, pep_q_value FROM z")
def peptide_qvalue(spark, sf_dir):
    return fd.assign_q_values(matches(spark, sf_dir)).select("match_id", "pep_q_value")


@query(f"{FDR_SQL} SELECT count(*) AS matches, count(*) FILTER (NOT is_decoy) AS targets, count(*) FILTER (NOT is_decoy AND q_value <= CAST(0.01 AS FLOAT)) AS ids_1, count(*) FILTER (NOT is_decoy AND q_value <= CAST(0.05 AS FLOAT)) AS ids_5 FROM z")
def ids_at_fdr(spark, sf_dir):
    return fd.summary(fd.assign_q_values(matches(spark, sf_dir)))


@query("""SELECT s_suppkey, upper(CASE WHEN length(p) >= 4 AND substr(p, 2, 1) = '.' AND substr(p, length(p) - 1, 1) = '.' THEN substr(p, 3, length(p) - 4) ELSE p END) AS key
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'K.' || s_name || '.R' ELSE s_name END AS p FROM supplier)""")
def peptide_key(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    p = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("K."), "s_name", F.lit(".R"))).otherwise(F.col("s_name"))
    return s.select("s_suppkey", chem.peptide_key(p).alias("key"))


@query(f"WITH g AS (SELECT peptide, score, list_sort(list(protein)) AS proteins FROM ({MATCHES_SQL}) GROUP BY ALL) SELECT peptide, score, unnest(proteins) AS protein FROM g")
def tsv_unroll(spark, sf_dir):
    return fd.rolled_up(matches(spark, sf_dir).select("peptide", "score", "protein")).select("peptide", "score", F.explode_outer("proteins").alias("protein"))


@query("SELECT charge, count(*) AS n FROM (SELECT 2 + o_orderkey % 2 AS charge FROM orders) GROUP BY charge")
def charge_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((2 + F.col("o_orderkey") % 2).alias("charge")).agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT spec_index, mz, row_number() OVER (PARTITION BY spec_index ORDER BY intensity DESC, mz DESC, {', '.join(_TIES)}) AS rank FROM ({PEAKS_SQL}))
SELECT mz // 50000 AS segment, least(rank, 5)::INTEGER AS bin, count(*) AS n FROM r GROUP BY ALL""")
def rank_histogram(spark, sf_dir):
    r = ma.ranked_peaks(peaks(spark, sf_dir), _TIES)
    return r.groupBy(F.floor(F.col("mz") / 50000).alias("segment"), F.least("rank", F.lit(5)).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT c_nationkey AS charge, c_acctbal AS mass, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT DISTINCT charge, part, mass FROM (SELECT charge, p::INTEGER AS part, mass FROM r, (SELECT unnest(range(0, 4)) AS p) WHERE rn = p * n // 4)""")
def quantile_partitions(spark, sf_dir):
    from massspark.operators.train import quantile_starts

    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("charge"), F.col("c_acctbal").alias("mass"), F.col("c_custkey").alias("tie"))
    return quantile_starts(rows, ["charge"], "mass", ["tie"], 4)


@query("""WITH w AS (SELECT c_nationkey AS k, count(*) AS n, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1) SELECT k, n, v[n // 2 + 1] AS upper_median FROM w""")
def precursor_offset_median(spark, sf_dir):
    from massspark.operators.train import upper_median

    return upper_median(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal"), ["k"], "c_acctbal")


@query(f"""WITH b AS (SELECT peptide, min(score) FILTER (NOT is_decoy) AS t, min(score) FILTER (is_decoy) AS d FROM ({MATCHES_SQL}) GROUP BY 1)
SELECT count(*) AS pairs, count(*) FILTER (t < d) AS target_better, round(avg(CASE WHEN t < d THEN 1.0 ELSE 0.0 END), 6) AS rate FROM b WHERE t IS NOT NULL AND d IS NOT NULL""")
def eval_target_beats_decoy(spark, sf_dir):
    b = matches(spark, sf_dir).groupBy("peptide").agg(F.min(F.when(~F.col("is_decoy"), F.col("score"))).alias("t"), F.min(F.when(F.col("is_decoy"), F.col("score"))).alias("d"))
    better = F.col("t") < F.col("d")
    return b.where("t is not null and d is not null").agg(F.count("*").alias("pairs"), F.count_if(better).alias("target_better"), F.round(F.avg(F.when(better, 1.0).otherwise(0.0)), 6).alias("rate"))


@query("""WITH r AS (SELECT o_orderpriority AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS y FROM orders)
SELECT k, round(corr(x, y), 6) AS rho FROM r GROUP BY k""")
def eval_spearman(spark, sf_dir):
    from massspark.operators.train import spearman

    return spearman(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey").select(F.col("o_orderpriority").alias("k"), F.round("rho", 6).alias("rho"))


@query(f"""WITH p AS (SELECT spec_index, l_linenumber, cents, mz // 1000 AS bin FROM ({PEAKS_SQL})), o AS (SELECT o_orderkey, (10000 + CAST(round(o_totalprice * 100) AS BIGINT) % 150000) // 1000 AS bin FROM orders)
SELECT spec_index, l_linenumber, cents, bin FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_orderkey = spec_index AND abs(o.bin - p.bin) <= 1)""")
def decoy_site_filter(spark, sf_dir):
    p = peaks(spark, sf_dir).select("spec_index", "l_linenumber", "cents", F.floor(F.col("mz") / 1000).alias("bin"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_index"), F.floor((10000 + F.round(F.col("o_totalprice") * 100).cast("bigint") % 150000) / 1000).alias("bin"))
    return ma.away_from(p, o, ["spec_index"], "bin").select("spec_index", "l_linenumber", "cents", "bin")


_NOMINAL_SQL = f"CAST(round(CAST(CAST({{x}} AS FLOAT) * CAST({chem.NOMINAL} AS FLOAT) AS FLOAT)) AS INTEGER)"


@query(f"""WITH m(residue, mass) AS (VALUES {MASS_LIST}), d AS (SELECT DISTINCT peptide FROM ({PEPTIDES_SQL})),
r AS (SELECT peptide, CAST(unnest(range(1, length(peptide) + 1)) AS INTEGER) AS i, unnest(string_split(peptide, '')) AS residue FROM d)
SELECT peptide, i, round(sum(mass) OVER w, 6) AS accurate, CAST(sum({_NOMINAL_SQL.format(x='mass')}) OVER w AS INTEGER) AS nominal FROM r JOIN m USING (residue) WINDOW w AS (PARTITION BY peptide ORDER BY i)""")
def prefix_masses(spark, sf_dir):
    rows = peptides(spark, sf_dir).select("peptide").distinct().withColumn("sites", chem.residues(F.col("peptide")))
    sums = F.arrays_zip(chem.accurate_prefix_masses(F.col("sites")).alias("a"), chem.nominal_prefix_masses(F.col("sites")).alias("n"))
    rows = rows.select("peptide", F.posexplode(sums).alias("i", "x"))
    return rows.select("peptide", (F.col("i") + 1).alias("i"), F.round("x.a", 6).alias("accurate"), F.col("x.n").alias("nominal"))


@query(f"""WITH m(residue, mass) AS (VALUES {MASS_LIST}), d AS (SELECT DISTINCT peptide FROM ({PEPTIDES_SQL})),
r AS (SELECT peptide, unnest(string_split(peptide, '')) AS residue FROM d),
x AS (SELECT peptide, sum(mass) + {chem.WATER!r} AS mass FROM r JOIN m USING (residue) GROUP BY peptide),
t AS (SELECT peptide, mass, CAST(contains(peptide, 'M') AS INTEGER) AS has FROM x)
SELECT regexp_replace(peptide, 'M', 'M+15.995') AS text, has AS n_mods, CAST(length(peptide) AS INTEGER) AS n, round(mass + 15.995 * has, 6) AS mass, 'K.' || regexp_replace(peptide, 'M', 'M+15.995') || '.-' AS again FROM t""")
def annotated_peptides(spark, sf_dir):
    """Peptides with an inline mass change, parsed, weighed and written again."""
    rows = peptides(spark, sf_dir).select("peptide").distinct()
    text = F.when(F.contains("peptide", F.lit("M")), F.concat(F.substring_index("peptide", "M", 1), F.lit("M+15.995"), F.expr("substring(peptide, instr(peptide, 'M') + 1)"))).otherwise(F.col("peptide"))
    rows = rows.select(text.alias("text")).withColumn("sites", chem.residues(F.col("text")))
    mass = F.aggregate("sites", F.lit(chem.WATER), lambda a, x: a + chem.site_mass(x))
    return rows.select("text", chem.num_mods(F.col("sites")).alias("n_mods"), F.size("sites").alias("n"), F.round(mass, 6).alias("mass"), chem.peptide_string(F.col("sites"), F.lit("K"), F.lit("-")).alias("again"))


@query(f"""SELECT accession, start, len, CAST((CASE WHEN prot_n OR (start = 1 AND pre = 'M') OR pre IN ('K', 'R') THEN {chem.CREDIT} ELSE {chem.PENALTY} END) + (CASE WHEN right(peptide, 1) IN ('K', 'R') THEN {chem.CREDIT} ELSE {chem.PENALTY} END) AS INTEGER) AS searched,
  CAST((CASE WHEN pre IN ('K', 'R', '-') THEN {chem.CREDIT} ELSE {chem.PENALTY} END) + (CASE WHEN right(peptide, 1) IN ('K', 'R') THEN {chem.CREDIT} ELSE {chem.PENALTY} END) AS INTEGER) AS rescored FROM ({PEPTIDES_SQL})""")
def cleavage_credit(spark, sf_dir):
    p = peptides(spark, sf_dir)
    flanked = F.concat("pre", F.lit("."), "peptide", F.lit("."), "post")
    after_met = (F.col("start") == 1) & (F.col("pre") == "M")
    return p.select("accession", "start", "len", chem.search_cleavage(F.col("pre"), F.col("peptide"), F.col("prot_n"), after_met).alias("searched"), chem.rescore_cleavage(flanked).alias("rescored"))


@query(f"""SELECT p_partkey, round((p_retailprice - k * {chem.ISOTOPE} - (p_retailprice - 0.01)) / (p_retailprice - 0.01) * 1e6, 4) AS ppm, abs(p_retailprice - (p_retailprice - 0.01)) <= (p_retailprice - 0.01) * 10.0 / 1e6 AS near,
  round((p_retailprice - 0.01) - (p_retailprice - 0.01) * 10.0 / 1e6, 6) AS low, round((p_retailprice - 0.01) + (p_retailprice - 0.01) * 10.0 / 1e6, 6) AS high FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p_retailprice, p_partkey % 3 AS k FROM part)""")
def precursor_error(spark, sf_dir):
    observed, k = F.col("p_retailprice").cast("double"), F.col("p_partkey") % 3
    theoretical, tolerance = observed - 0.01, chem.Tolerance.parse("10ppm")
    low, high = tolerance.bounds(theoretical)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(chem.precursor_error_ppm(observed, theoretical, k), 4).alias("ppm"), tolerance.matches(theoretical, observed).alias("near"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""SELECT p_partkey, CAST(p / z + {chem.PROTON} AS FLOAT) AS mz, CAST((CAST(CAST(p / z + {chem.PROTON} AS FLOAT) AS DOUBLE) - {chem.PROTON}) * z AS FLOAT) AS mass,
  CAST(round(CAST(CAST(p AS FLOAT) * CAST({chem.HIGH_RESOLUTION} AS FLOAT) AS FLOAT)) AS INTEGER) AS fine, CAST(CAST(z + 100 AS FLOAT) / CAST({chem.NOMINAL} AS FLOAT) AS FLOAT) AS centre
FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p, CAST(1 + p_partkey % 3 AS INTEGER) AS z FROM part)""")
def ion_positions(spark, sf_dir):
    p, z = F.col("p_retailprice").cast("double"), (1 + F.col("p_partkey") % 3).cast("int")
    mz = chem.ion_mz(p, chem.PROTON, z)
    return table(spark, sf_dir, "part").select("p_partkey", mz.alias("mz"), chem.ion_mass(mz, chem.PROTON, z).alias("mass"), chem.high_resolution_bin(p).alias("fine"), chem.nominal_to_mass(z + 100).alias("centre"))


@query(f"""WITH c(name, d) AS (VALUES ('', 0.0::DOUBLE), ('-H2O', -{chem.WATER!r}), ('-NH3', -({chem.ATOMS['N']!r} + 3 * {chem.ATOMS['H']!r})), ('-CO', -({chem.ATOMS['C']!r} + {chem.ATOMS['O']!r})), ('+i', {chem.ISOTOPE!r}), ('+2i', 2 * {chem.ISOTOPE!r})),
k AS (SELECT side = 'b' AS is_prefix, z, side || name || '_' || z AS name, (d + CASE WHEN side = 'y' THEN {chem.WATER!r} ELSE 0 END) / z + {chem.PROTON} AS shift FROM c, (SELECT unnest(['b', 'y']) AS side), (SELECT unnest([1, 2, 3]) AS z))
SELECT c_custkey, is_prefix, name, round(CAST(c_acctbal AS DOUBLE) / z + shift, 6) AS mz FROM customer JOIN k ON z <= 1 + c_custkey % 3""")
def ion_kinds(spark, sf_dir):
    """Each kind of ion that a charge allows, at a sum of residues (here a balance)."""
    kinds = F.array(*[F.struct(F.lit(k.prefix).alias("is_prefix"), F.lit(k.charge).alias("z"), F.lit(k.name).alias("name"), F.lit(k.offset).alias("shift")) for k in ma.ion_kinds(3)])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("sum"), F.explode(F.filter(kinds, lambda k: k["z"] <= 1 + F.col("c_custkey") % 3)).alias("k"))
    return rows.select("c_custkey", "k.is_prefix", "k.name", F.round(F.col("sum") / F.col("k.z") + F.col("k.shift"), 6).alias("mz"))


@query(f"SELECT spec_index, mz, intensity, cents, l_linenumber, CAST(row_number() OVER (PARTITION BY spec_index ORDER BY intensity DESC, l_linenumber, cents, l_partkey, l_suppkey, l_shipdate) AS INTEGER) AS rank FROM ({PEAKS_SQL})")
def simple_rank(spark, sf_dir):
    rows = peaks(spark, sf_dir).withColumn("position", F.struct("l_linenumber", "cents", "l_partkey", "l_suppkey", "l_shipdate"))
    return ma.simple_rank(rows, "position").select("spec_index", "mz", "intensity", "cents", "l_linenumber", "rank")


@query("""SELECT o_orderkey AS spec_index, CAST(unnest(CASE WHEN o_orderkey % 3 > 0 THEN [o_orderkey % 3] ELSE [2, 3] END) AS INTEGER) AS charge FROM orders WHERE o_orderkey % 5 <> 0""")
def charge_expand(spark, sf_dir):
    """Spectra with a precursor; those without a charge once for each charge of the range."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_index"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3).cast("int").alias("charge"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("double")).alias("precursor_mz"))
    return ma.with_charges(o).select("spec_index", "charge")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS scan, max(o_orderkey) AS spec_index, round(CAST(arg_max(o_totalprice, o_orderkey) AS DOUBLE), 2) AS precursor_mz FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1""")
def last_by_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("scan"), F.col("o_orderkey").alias("spec_index"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("double")).alias("precursor_mz"))
    return ma.last_by_scan(o).select("scan", "spec_index", F.round("precursor_mz", 2).alias("precursor_mz"))


_METHODS = "['scan UVPD', 'x EThcD', 'etd 5', 'CID.HCD', 'cid ETD', 'none']"


@query(f"""SELECT p_partkey, CASE WHEN contains(t, 'HCD') THEN 'HCD' WHEN contains(t, 'CID') THEN 'CID' WHEN contains(t, 'ETD') THEN 'ETD' WHEN contains(t, 'UVPD') THEN 'UVPD' ELSE 'N/A' END AS method
FROM (SELECT p_partkey, upper({_METHODS}[1 + p_partkey % 6]) AS t FROM part)""")
def fragmentation_method(spark, sf_dir):
    title = F.element_at(F.expr("array" + _METHODS.replace("[", "(").replace("]", ")")), (1 + F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", chem.fragmentation_method(title).alias("method"))


@query(f"""SELECT spec_index, md5(string_agg(printf('%.5f %.5f', CAST(mz AS DOUBLE), CAST(intensity AS DOUBLE)), chr(10) ORDER BY mz, intensity)) AS peaks, round(sum(CAST(intensity AS DOUBLE)), 4) AS tic FROM ({PEAKS_SQL}) GROUP BY spec_index""")
def canonical_peaks(spark, sf_dir):
    rows = peaks(spark, sf_dir).groupBy("spec_index").agg(F.array_sort(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity")))).alias("p"))
    return rows.select("spec_index", F.md5(chem.canonical_peaks(F.col("p"))).alias("peaks"), F.round(chem.tic(F.col("p")), 4).alias("tic"))


_DISTRIBUTIONS_SQL = "SELECT l_orderkey AS k, CAST(l_orderkey % 5 AS INTEGER) - 2 AS min_score, list(l_discount ORDER BY l_discount, l_quantity) AS probs FROM lineitem GROUP BY l_orderkey"


def _distributions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_discount")).alias("probs"))
    return line.withColumn("min_score", (F.col("k") % 5).cast("int") - 2)


@query(f"""SELECT k, round(least(1.0, coalesce(list_sum(probs[greatest(1 - min_score, 0) + 1:]), 0.0)), 9) AS p, min_score + len(probs)::INTEGER AS beyond FROM ({_DISTRIBUTIONS_SQL})""")
def tail_probability(spark, sf_dir):
    p = dist.tail_probability(F.col("min_score"), F.col("probs"), F.lit(1))
    return _distributions(spark, sf_dir).select("k", F.round(p, 9).alias("p"), dist.max_score(F.col("min_score"), F.col("probs")).alias("beyond"))


@query(f"""SELECT k, min_score - 11 AS low, CASE WHEN p > 0 THEN round(0.001 / p, 9) END AS relative FROM (SELECT k, min_score, round(coalesce(list_sum(probs), 0.0), 6) AS p FROM ({_DISTRIBUTIONS_SQL}))""")
def distribution_error(spark, sf_dir):
    p = F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 6)
    return _distributions(spark, sf_dir).select("k", dist.shifted(F.col("min_score"), F.lit(chem.PENALTY)).alias("low"), F.round(dist.relative_error(F.lit(0.001), p), 9).alias("relative"))


_CERTIFIED_SQL = f"SELECT k % 7 AS g, min_score, probs, CAST(k % 11 AS INTEGER) AS valid_from, (k % 16) / 1024.0 AS error, CAST(k % 29 AS INTEGER) AS best FROM ({_DISTRIBUTIONS_SQL})"


@query(f"""WITH d AS ({_CERTIFIED_SQL}), s AS (SELECT g, min_score + i::INTEGER AS score, sum(p) AS p FROM (SELECT g, min_score, unnest(range(0, len(probs))) AS i, unnest(probs) AS p FROM d) GROUP BY ALL),
a AS (SELECT g, unnest(range(min(score), max(score) + 1)) AS score FROM s GROUP BY g),
f AS (SELECT a.g, min(a.score)::INTEGER AS min_score, list(round(coalesce(p, 0.0), 6) ORDER BY a.score) AS probs FROM a LEFT JOIN s ON a.g = s.g AND a.score = s.score GROUP BY a.g)
SELECT g, min_score, probs, max(valid_from) AS valid_from, CAST(sum(error) AS DOUBLE) AS error, max(best) AS best FROM f JOIN (SELECT g, valid_from, error, best FROM d) USING (g) GROUP BY ALL""")
def merge_distributions(spark, sf_dir):
    rows = _distributions(spark, sf_dir).select((F.col("k") % 7).alias("g"), "min_score", "probs", (F.col("k") % 11).cast("int").alias("valid_from"), ((F.col("k") % 16) / 1024.0).alias("error"), (F.col("k") % 29).cast("int").alias("best"))
    return dist.merged(rows, ["g"]).withColumn("probs", F.transform("probs", lambda p: F.round(p, 6)))


@query("""WITH r AS (SELECT c_mktsegment AS g, round((c_acctbal + 1000) / 11000, 6) AS claimed, c_custkey % 3 = 0 AS decoy FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY claimed, decoy) - 1 AS place, count(*) OVER (PARTITION BY g) AS size FROM r)
SELECT g, CAST(place * 10 // size AS INTEGER) AS bin, count(*) AS n, min(claimed) AS low, max(claimed) AS high, round(avg(claimed), 6) AS claimed, round(avg(CASE WHEN decoy THEN 1.0 ELSE 0.0 END), 6) AS observed FROM p GROUP BY 1, 2""")
def eval_calibration(spark, sf_dir):
    from massspark.operators.train import calibration

    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.round((F.col("c_acctbal") + 1000) / 11000, 6).alias("claimed"), (F.col("c_custkey") % 3 == 0).alias("decoy"))
    return calibration(rows, ["g"], "claimed", "decoy", 10).withColumns({c: F.round(c, 6) for c in ("claimed", "observed")})


@query(f"""WITH b AS (SELECT score_group AS g, peptide, max(CASE WHEN NOT is_decoy THEN -score END) - max(CASE WHEN is_decoy THEN -score END) AS gap FROM (SELECT *, hash_group AS score_group FROM (SELECT *, match_id % 3 AS hash_group FROM ({MATCHES_SQL}))) GROUP BY 1, 2),
l AS (SELECT g, list_sort(list(gap)) AS v FROM b WHERE gap IS NOT NULL GROUP BY g)
SELECT g, len(v)::BIGINT AS n, round(v[len(v) // 2 + 1]::DOUBLE, 4) AS median_gap FROM l""")
def eval_median_gap(spark, sf_dir):
    from massspark.operators.train import median_gap

    rows = matches(spark, sf_dir).select((F.col("match_id") % 3).alias("g"), "peptide", (-F.col("score")).alias("score"), "is_decoy")
    return median_gap(rows, ["g"], "peptide", "score", "is_decoy").withColumn("median_gap", F.round(F.col("median_gap").cast("double"), 4))


@query()
def synthetic_spectra(spark, sf_dir):
    return annotated(spark, sf_dir).withColumns({"peaks": F.md5(chem.canonical_peaks(F.col("peaks"))), "n_peaks": F.size("peaks"), "tic": F.round(chem.tic(F.col("peaks")), 4)})


@query()
def corpus_screen(spark, sf_dir):
    from massspark.operators.train import corpus_counts

    return corpus_counts(annotated(spark, sf_dir))


@query()
def train_model(spark, sf_dir):
    """The trained model as one relation of its fragment frequencies. Trains anew."""
    from massspark.operators.train import train
    from massspark.sources.model import tables

    return tables(spark, train(annotated(spark, sf_dir)))["fragments"]


@query()
def model_roundtrip(spark, sf_dir):
    """Every frequency table of the model after writing and reading its binary stream."""
    from massspark.sources.model import decode, encode, tables

    t = tables(spark, decode(encode(model(spark, sf_dir))))
    ranks, errors = (t[k].select("partition", F.lit(k).alias("table"), F.col(c).alias("kind"), "bin", "freq") for k, c in (("ranks", "ion"), ("errors", "kind")))
    fragments = t["fragments"].select("partition", F.lit("fragments").alias("table"), F.col("name").alias("kind"), F.col("ion_idx").alias("bin"), F.col("frequency").alias("freq"))
    partitions = t["partitions"].select("partition", F.lit("partitions").alias("table"), F.concat_ws("/", "charge", "seg").alias("kind"), F.lit(0).alias("bin"), F.col("parent_mass").alias("freq"))
    return ranks.unionByName(errors).unionByName(fragments).unionByName(partitions)


@query()
def search(spark, sf_dir):
    """Planted peptides searched against targets and reversed decoys, with a model trained on them."""
    from massspark.operators.search import search as run

    return run(annotated(spark, sf_dir).drop("seq"), dig.with_decoys(short_proteins(spark, sf_dir)), model(spark, sf_dir))


@query()
def rescore(spark, sf_dir):
    from massspark.operators.search import rescore as run

    spectra = annotated(spark, sf_dir)
    rows = spectra.select(F.col("spec_index").alias("input_pos"), "scan", F.col("seq").alias("peptide"), "charge")
    return run(rows, spectra, model(spark, sf_dir), db_size=1000)


@query()
def rescore_estimates(spark, sf_dir):
    """Rescoring with certified pruning, saddlepoint estimates beside it: the exact tail lies in [spec_evalue, spec_evalue + spec_error]."""
    from massspark.operators.search import Tails
    from massspark.operators.search import rescore as run

    spectra = annotated(spark, sf_dir)
    rows = spectra.select(F.col("spec_index").alias("input_pos"), "scan", F.col("seq").alias("peptide"), "charge")
    return run(rows, spectra, model(spark, sf_dir), tails=Tails(estimate=True, cap=20, share=1e-3))


@query()
def training_report(spark, sf_dir):
    """The partitions of a training report, with the counts of its screen. Trains anew."""
    from massspark.operators.train import train_with_report

    report = train_with_report(annotated(spark, sf_dir))[1]
    seen = report["spectra"]
    rows = [(p["charge"], p["parent_mass"], p["segment"], p["spectra"], p["main_ion"], len(p["ions"]), seen["read"], seen["kept"]) for p in report["partitions"]]
    return spark.createDataFrame(rows, "charge int, parent_mass double, segment int, spectra long, main_ion string, ions int, spectra_read long, spectra_kept long")


@query()
def search_bundled(spark, sf_dir):
    """The planted peptides searched with the bundled model, without training."""
    from massspark.operators.search import search as run

    return run(annotated(spark, sf_dir).drop("seq"), dig.with_decoys(short_proteins(spark, sf_dir)))
