"""The model that the package ships, and which model a run takes."""

from __future__ import annotations

import hashlib
from importlib import resources

from pyspark.sql import SparkSession

from massspark.sources.model import Model, decode, read_model, read_stored

NAME, DIGEST = "synthetic_hcd_tryp.model", "16cb75e666fb52f127119bbefb914b8adc24753d2f5a82d39a73f43392b14160"
PROVENANCE = "trained by train() on made-up spectra of the tryptic peptides of made-up texts; no measured spectra"


def bundled_model() -> Model:
    """The package's own model, decoded from its resource; an error if that isn't the one whose digest is pinned."""
    data = resources.files("massspark.sources").joinpath(NAME).read_bytes()
    found = hashlib.sha256(data).hexdigest()
    if found != DIGEST:
        raise ValueError(f"{NAME}: the digest is {found}, not {DIGEST}")
    return decode(data)


def resolve_model(spark: SparkSession, model: Model | str | None = None) -> tuple[Model, str]:
    """A model and where it came from: one that is given, one of a path (a binary stream, or a table of write_model()), or the bundled one."""
    if isinstance(model, Model):
        return model, "given"
    if model is None:
        return bundled_model(), f"{NAME} ({PROVENANCE})"
    found = spark._jvm.org.apache.hadoop.fs.Path(model)
    folder = found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()
    return (read_stored if folder else read_model)(spark, model), model
