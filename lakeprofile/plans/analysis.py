"""Whole analyses: one table, or every table of a directory."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import small_table
from lakeprofile.plans import correlation, distribution, missing, outlier, quality, target as targets
from lakeprofile.plans.profile import Profile
from lakeprofile.sources.files import list_files
from lakeprofile.sources.load import load_table, prepare
from lakeprofile.sources.sink import write_sections

BATCH_EXTENSIONS = (".csv", ".xlsx", ".parquet")
# Tables profiled at the same time.
MAX_TABLES = 3


def analyze(
    source: DataFrame | Profile,
    target: str | None = None,
    rules: outlier.Rules = outlier.Rules(),
    skip_correlation: bool = False,
    skip_outlier: bool = False,
    gate: bool = True,
) -> dict[str, DataFrame]:
    """Every section of a profile as small tables; skipped sections are not computed."""
    p = Profile.of(source)
    if target is not None:
        targets.ensure_target(p.df, target)
    p.prepare("moments")  # everything below builds on this scan
    if gate and not p.rows:
        quality.issues(p)
    p.prepare("frequencies", "duplicates", "number_cells")
    p.prepare(
        *([] if skip_correlation else ["vif", "spearman"]), *([] if skip_outlier else ["mad"])
    )
    out = {
        "quality": quality.quality_issues(p, gate),
        "quality_status": quality.quality_status(p),
        "overview": quality.overview(p),
        "distribution_numeric": distribution.numeric_stats(p),
        "distribution_categorical": distribution.categorical_stats(p),
        "missing_columns": missing.missing_columns(p),
        "missing_summary": missing.missing_summary(p),
        "missing_patterns": missing.missing_patterns(p),
        "missing_pairs": missing.correlated_missing(p),
    }
    if not skip_correlation:
        out |= {
            "correlation_pearson": correlation.pearson_matrix(p),
            "correlation_spearman": correlation.spearman_matrix(p),
            "correlation_strong_pairs": correlation.strong_pairs(p),
            "correlation_cramers_v": correlation.cramers_matrix(p),
            "correlation_point_biserial": correlation.point_biserial(p),
            "correlation_vif": correlation.vif(p),
            "correlation_notes": correlation.correlation_notes(p),
        }
    if not skip_outlier:
        out["outlier"] = outlier.outliers(p, rules)
    if target is not None:
        out["target"] = targets.feature_table(p, target)
        out["target_notes"] = targets.target_notes(p, target)
    return out


def profile_many(
    tables: dict[str, DataFrame], **options
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Sections of many tables, each row tagged with its ``dataset``, and (dataset, status, error).

    A table that fails is recorded and does not stop the others.
    """
    found = _side_by_side({n: lambda df=df: analyze(df, **options) for n, df in tables.items()})
    sections: dict[str, DataFrame] = {}
    for name, (parts, _) in found.items():
        for section, part in (parts or {}).items():
            tagged = part.withColumn("dataset", F.lit(name))
            sections[section] = (
                sections[section].unionByName(tagged) if section in sections else tagged
            )
    if not tables:
        return {}, None
    spark = next(iter(tables.values())).sparkSession
    return sections, _status(spark, found)


def _side_by_side(work: dict[str, Callable[[], object]]) -> dict[str, tuple]:
    """(result, error) of every piece of work, a few at a time."""

    def run(job: Callable[[], object]) -> tuple:
        try:
            return job(), None
        except Exception as e:  # noqa: BLE001 - one table's failure is a result
            return None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(MAX_TABLES) as pool:
        return dict(zip(work, pool.map(run, work.values()), strict=True))


def _status(spark: SparkSession, found: dict[str, tuple]) -> DataFrame:
    rows = [(n, "ok" if error is None else "failed", error) for n, (_, error) in found.items()]
    return small_table(spark, rows, "dataset string, status string, error string")


def batch(
    spark: SparkSession,
    directory: str,
    output: str | None = None,
    drop: list[str] | None = None,
    sample: int | None = None,
    **options,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Profile every file of a directory.

    With ``output`` each file's sections are written there as it is done, below dataset=<name>, and
    read back as tables partitioned by dataset, so no plan grows with the number of files.
    """
    files = {p.rsplit("/", 1)[-1]: p for p in list_files(directory, BATCH_EXTENSIONS, spark)}

    def profile(name: str) -> dict[str, DataFrame]:
        sections = analyze(prepare(load_table(spark, files[name]), drop, sample), **options)
        if output:
            for section, df in sections.items():
                write_sections({f"{section}/dataset={name}": df}, output)
        return sections

    if not output:
        tables, broken = {}, {}
        opened = _side_by_side({
            n: lambda p=p: prepare(load_table(spark, p), drop, sample) for n, p in files.items()
        })
        for name, (df, error) in opened.items():
            if error is None:
                tables[name] = df
            else:
                broken[name] = (None, error)
        sections, status = profile_many(tables, **options)
        failed = _status(spark, broken)
        return sections, failed if status is None else status.unionByName(failed)
    found = _side_by_side({n: lambda n=n: profile(n) for n in files})
    status = _status(spark, found)
    write_sections({"status": status}, output)
    schemas = {s: df.schema for parts, _ in found.values() for s, df in (parts or {}).items()}
    base = output.rstrip("/")
    sections = {
        s: spark.read.schema(T.StructType([*schema.fields, T.StructField("dataset", T.StringType())]))
        .json(f"{base}/{s}")
        for s, schema in schemas.items()
    }
    return sections, status
