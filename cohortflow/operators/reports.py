"""Labelled report tables built from posterior summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .draws import extract_indexed


def stack_labelled(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """UNION ALL of labelled result sets (a literal label column each)."""
    out = None
    for name, df in frames.items():
        d = df.withColumn(label, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def ribbon(summary: DataFrame, param: str, mappings, keys=("run_id",)) -> DataFrame:
    """Credible ribbon (q5, q50, q95) per label of one parameter."""
    ex = extract_indexed(summary, param, mappings=mappings)
    names = [n for n, _ in (mappings.items() if isinstance(mappings, Mapping) else mappings)]
    keep = [k for k in keys if k in ex.columns]
    return ex.select(*keep, *names, "q5", "q50", "q95")


def scenario_report(summary: DataFrame, year_dim: DataFrame, param: str = "total_pop",
                    scenario_col: str = "run_id") -> DataFrame:
    """Scenario comparison: survey label, year, mean, q5, median, q95; sorted.

    ``summary`` holds several runs (one per scenario) in ``scenario_col``;
    the year mapping of the first run is applied to all, as the reference
    notebook does.
    """
    ex = extract_indexed(summary, param, mappings={"year": year_dim})
    out = ex.select(F.col(scenario_col).alias("survey"), F.col("year").cast("int").alias("year"),
                    "mean", "q5", F.col("q50").alias("median"), "q95")
    return out.orderBy("survey", "year")


def population_parts(summary: DataFrame, year_dim: DataFrame) -> DataFrame:
    """Totals by population part: all, native-born, migrant (one table)."""
    parts = {
        "all": r"total_pop\[",
        "native-born": "total_native_pop",
        "migrant": "total_mig_pop",
    }
    frames = {label: extract_indexed(summary, rx, mappings={"year": year_dim})
              for label, rx in parts.items()}
    return stack_labelled(frames, "population")


def migration_detail(summary: DataFrame, year_dim: DataFrame, age_dim: DataFrame,
                     before_year: int = 1985) -> DataFrame:
    """Migrant cohorts by cohort year x period x age, with facet labels.

    Keeps periods at or after the cohort's arrival and cohorts that arrived
    before ``before_year``.
    """
    ex = extract_indexed(summary, "pop_mig_true",
                         mappings=[("mig_year", year_dim), ("year", year_dim), ("age", age_dim)])
    ex = ex.where((F.col("year") >= F.col("mig_year")) & (F.col("mig_year") < before_year))
    return ex.withColumns({
        "mig_label": F.concat(F.lit("Mig. year: "), F.col("mig_year").cast("string")),
        "year_label": F.concat(F.lit("t = "), F.col("year").cast("string")),
    })


def migration_inflow(summary: DataFrame, year_dim: DataFrame) -> DataFrame:
    """New migrants per period; anchored so log_... totals do not match."""
    return extract_indexed(summary, r"^pop_mig_init_total", mappings={"year": year_dim})


def overlay_rates(rate_summary: DataFrame, rates: DataFrame, rate_col: str,
                  keys=("year", "age")) -> DataFrame:
    """Input rates laid over posterior ribbons on the same (year, age) axes.

    Adds the input rate, its distance to the posterior median and whether it
    lies inside the 90 % interval.
    """
    extra = [c for c in rates.columns if c not in keys and c != rate_col]
    r = rates.select(*extra, *keys, F.col(rate_col).alias("input_rate"))
    out = rate_summary.join(r, list(keys), "left")
    return out.withColumns({
        "diff_q50": F.col("input_rate") - F.col("q50"),
        "inside_90": (F.col("input_rate") >= F.col("q5")) & (F.col("input_rate") <= F.col("q95")),
    })
