"""Stand-in inputs built from the driver's tables.

The domain inputs (wide rate tables, life tables, survey microdata, draws)
are defined as SQL over the driver's parquet tables. Each view is written
once as a template and rendered for two dialects: Spark SQL (the engine,
via ``spark.sql(text, **frames)``) and DuckDB (the oracle). All fixture
arithmetic is integer-exact or a single IEEE operation so both engines see
bit-identical inputs.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "embeddings")

# Band labels of the wide tables.
FERT_BANDS = ["15-19", "20-24", "25-29", "30-34", "35-39", "40-44", "45-49"]
POP_BANDS = ["0-4", "5-9", "10-14", "15-19", "20-24", "25-29", "30-34",
             "35-39", "40-44", "45-49", "50+"]
EMPTY_CELL = "…"


def _q(dialect: str, ident: str) -> str:
    return f"`{ident}`" if dialect.startswith("spark") else f'"{ident}"'


def _t(dialect: str, name: str) -> str:
    return "{" + name + "}" if dialect.startswith("spark") else name


def _period_start(ts: str) -> str:
    # 16 five-year periods 1950..2025 from months since 1995-01.
    return (f"1950 + 5 * CAST(floor((12 * (year({ts}) - 1995) + month({ts}) - 1) / 5) AS INTEGER)")


def _base_rows(d: str) -> str:
    """lineitem ⋈ orders ⋈ customer ⋈ nation → (region, start, age, q)."""
    t = partial(_t, d)
    return f"""
      SELECT n.n_name AS region,
             {_period_start('o.o_orderdate')} AS start,
             CASE WHEN l.l_quantity = 1 THEN 0
                  WHEN l.l_quantity < 5 THEN 1
                  ELSE 5 * CAST(floor(l.l_quantity / 5) AS INTEGER) END AS age,
             CAST(l.l_quantity AS BIGINT) AS q
      FROM {t('lineitem')} l
      JOIN {t('orders')} o ON l.l_orderkey = o.o_orderkey
      JOIN {t('customer')} c ON o.o_custkey = c.c_custkey
      JOIN {t('nation')} n ON c.c_nationkey = n.n_nationkey"""


# Fixed values of the rate fixtures: 16 five-year periods, abridged ages.
STARTS = (1950, 2025, 5)
AGES = (0, 1, *range(5, 55, 5))


def _cells(d: str) -> str:
    """Every (region, start, age) cell of the domain."""
    t = partial(_t, d)
    ages = ", ".join(map(str, AGES))
    if d == "spark":
        return f"""
        SELECT n_name AS region, start, age FROM {t('nation')}
        LATERAL VIEW explode(sequence({STARTS[0]}, {STARTS[1]}, {STARTS[2]})) ps AS start
        LATERAL VIEW explode(array({ages})) pa AS age"""
    return f"""
        SELECT region, start, unnest([{ages}]) AS age
        FROM (SELECT n_name AS region, unnest(generate_series({STARTS[0]}, {STARTS[1]}, {STARTS[2]})) AS start
              FROM {t('nation')}) pr"""


def _agg_rows(d: str) -> str:
    """Shared aggregate (region, start, age) -> sum and count of quantities, one more each.

    Every cell of the domain is emitted, so the rate tables have no holes at
    any scale. Every rate fixture is derived from it, so within one query
    Spark plans the lineitem scan, the joins and the aggregation once and
    reuses the exchange.
    """
    if d == "spark_base":   # rendered over an already materialised aggregate
        return "SELECT region, start, age, s, c FROM {agg}"
    return f"""
      SELECT cl.region, CAST(cl.start AS INTEGER) AS start, CAST(cl.age AS INTEGER) AS age,
             CAST(coalesce(gs.s, 0) + 1 AS BIGINT) AS s, CAST(coalesce(gs.c, 0) + 1 AS BIGINT) AS c
      FROM ({_cells(d)}) cl LEFT JOIN (
        SELECT region, start, age, SUM(q) AS s, COUNT(q) AS c FROM ({_base_rows(d)}) b
        GROUP BY region, start, age) gs
      ON gs.region = cl.region AND gs.start = cl.start AND gs.age = cl.age"""


def v_rate_base(d: str) -> str:
    return _agg_rows(d)


def v_life(d: str) -> str:
    """Abridged life table: Lx = persons at or above age x (text)."""
    return f"""
    SELECT region,
           CAST(start AS STRING) || '-' || CAST(start + 5 AS STRING) AS period,
           age,
           CAST(SUM(s) OVER (PARTITION BY region, start ORDER BY age DESC) AS STRING) AS Lx
    FROM ({_agg_rows(d)}) g"""


def _band_cell(d: str, lo: int, measure: str) -> str:
    return (f"coalesce(CAST({measure.format(cond=f'a5 = {lo}')} AS STRING), '{EMPTY_CELL}')")


def _wide(d: str, bands: list[str], measure: str, period_expr: str, having: str = "") -> str:
    # a sheet's period range is a HAVING on an aggregate, which stays above the
    # shared aggregate (a WHERE on start would be pushed into it and defeat reuse)
    cols = []
    for band in bands:
        lo = int(band.rstrip("+").split("-")[0])
        cols.append(f"{_band_cell(d, lo, measure)} AS {_q(d, band)}")
    return f"""
    SELECT region, {period_expr} AS period, 'Estimates' AS Variant, '' AS Notes,
           {', '.join(cols)}
    FROM (SELECT region, start, CASE WHEN age = 1 THEN 0 ELSE 5 * CAST(floor(age / 5) AS INTEGER) END AS a5, s, c
          FROM ({_agg_rows(d)}) g) w
    GROUP BY region, start
    {having}"""


_SUM_Q = "CAST(SUM(CASE WHEN {cond} THEN s END) AS BIGINT)"
_COUNT_Q_NULL = "CAST(NULLIF(SUM(CASE WHEN {cond} THEN c END), 0) AS BIGINT)"


def v_fert_wide(d: str) -> str:
    """Wide fertility table, per 1,000, period text '1950-1955'."""
    return _wide(d, FERT_BANDS, _SUM_Q,
                 "CAST(start AS STRING) || '-' || CAST(start + 5 AS STRING)")


def v_pop_wide(d: str) -> str:
    """Wide population table (estimates sheet), period = single year text."""
    return _wide(d, POP_BANDS, _SUM_Q, "CAST(start AS STRING)", "HAVING MAX(start) <= 1985")


def v_pop_wide_proj(d: str) -> str:
    """Projections sheet: overlaps the estimates at 1985 with other values."""
    return _wide(d, POP_BANDS, _COUNT_Q_NULL, "CAST(start AS STRING)", "HAVING MAX(start) >= 1985")


def v_person(d: str) -> str:
    """Survey registrations: gender, age, migration year, birth flag."""
    t = partial(_t, d)
    return f"""
    SELECT l_orderkey AS person_id, l_linenumber AS member,
           CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS basic_gender,
           l_quantity AS basic_age,
           CASE WHEN l_returnflag = 'N' THEN NULL
                ELSE CAST(1948 + 12 * (year(l_shipdate) - 1995) + month(l_shipdate) - 1 AS DOUBLE) END
             AS year_migration_m,
           CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS age_migration_m,
           CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS born_kenya_m
    FROM {t('lineitem')}"""


def v_household(d: str) -> str:
    """Household members: gender and age as text, NULL age when untaxed."""
    t = partial(_t, d)
    return f"""
    SELECT CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS gender,
           CASE WHEN l_tax = 0 THEN NULL
                ELSE CAST(CAST(l_quantity AS BIGINT) + l_linenumber AS STRING) END AS age
    FROM {t('lineitem')}"""


def v_band(d: str) -> str:
    """Banded survey: tribe, age band text, migration year text, birth place."""
    t = partial(_t, d)
    return f"""
    SELECT p_partkey,
           CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS tribe,
           CASE WHEN p_partkey % 23 = 0 THEN NULL
                WHEN p_size < 15 THEN 'Below 15'
                WHEN p_size < 25 THEN '15-25'
                WHEN p_size < 35 THEN '25-35'
                WHEN p_size < 45 THEN '35-45'
                WHEN p_size < 50 THEN '45-60'
                ELSE '60+' END AS age_member,
           CASE WHEN p_partkey % 7 = 0 THEN NULL
                WHEN p_partkey % 5 = 0 THEN 'Non applicable'
                ELSE CAST(1945 + p_partkey % 75 AS STRING) END AS mig,
           split_part(p_name, ' ', 1) AS cbirth
    FROM {t('part')}"""


def v_list(d: str) -> str:
    t = partial(_t, d)
    return f"""
    SELECT 'Brand#' || CAST(n_nationkey AS STRING) AS tribe_name
    FROM {t('nation')} WHERE n_regionkey = 0"""


def _exploded(d: str) -> str:
    t = partial(_t, d)
    if d == "spark":
        return f"""
        SELECT vec_id, label, p, CAST(x AS DOUBLE) AS x
        FROM {t('embeddings')} LATERAL VIEW posexplode(embedding) e AS p, x"""
    return f"""
        SELECT vec_id, label, p, CAST(x AS DOUBLE) AS x
        FROM (SELECT vec_id, label, unnest(embedding) AS x,
                     unnest(generate_series(0, len(embedding) - 1)) AS p
              FROM {t('embeddings')}) u"""


# A run has 4 chains of at most 500 draws; more embeddings make more runs, so
# a variable's group keeps the size of a sampler run at any scale.
RUN_DRAWS = 2000
_CHAIN = "CAST(vec_id % 4 AS INTEGER) + 1"
_ITER = f"CAST(floor((vec_id % {RUN_DRAWS}) / 4) AS INTEGER) + 1"
_RUN = (f"CASE WHEN vec_id < {RUN_DRAWS} THEN '' "
        f"ELSE ' ' || CAST(CAST(floor(vec_id / {RUN_DRAWS}) AS INTEGER) + 1 AS STRING) END")


def v_draws1(d: str) -> str:
    """Totals for two scenarios: total_pop[t] (both), native and migrant parts."""
    return f"""
    SELECT CASE WHEN p >= 16 AND p < 32 THEN 'not included' ELSE 'included' END || {_RUN} AS run_id,
           CASE WHEN p < 32 THEN 'total_pop[' || CAST(p % 16 + 1 AS STRING) || ']'
                WHEN p < 48 THEN 'total_native_pop[' || CAST(p - 31 AS STRING) || ']'
                ELSE 'total_mig_pop[' || CAST(p - 47 AS STRING) || ']' END AS variable,
           {_CHAIN} AS chain, {_ITER} AS iteration,
           1000 + 1000 * x AS value
    FROM ({_exploded(d)}) e"""


def v_draws2(d: str) -> str:
    """Rates: fert[t,a] (6 x 8) and the look-alike fert_sub[t,a] (4 x 4)."""
    return f"""
    SELECT 'included' || {_RUN} AS run_id,
           CASE WHEN p < 48
                THEN 'fert[' || CAST(CAST(floor(p / 8) AS INTEGER) + 1 AS STRING) || ','
                     || CAST(p % 8 + 1 AS STRING) || ']'
                ELSE 'fert_sub[' || CAST(CAST(floor((p - 48) / 4) AS INTEGER) + 1 AS STRING) || ','
                     || CAST((p - 48) % 4 + 1 AS STRING) || ']' END AS variable,
           {_CHAIN} AS chain, {_ITER} AS iteration,
           0.2 + x AS value
    FROM ({_exploded(d)}) e"""


def v_draws3(d: str) -> str:
    """Migrant cohorts pop_mig_true[m,t,a] (4 x 4 x 4)."""
    return f"""
    SELECT 'included' || {_RUN} AS run_id,
           'pop_mig_true[' || CAST(CAST(floor(p / 16) AS INTEGER) + 1 AS STRING) || ','
             || CAST(CAST(floor((p % 16) / 4) AS INTEGER) + 1 AS STRING) || ','
             || CAST(p % 4 + 1 AS STRING) || ']' AS variable,
           {_CHAIN} AS chain, {_ITER} AS iteration,
           100 + 100 * x AS value
    FROM ({_exploded(d)}) e"""


def v_params(d: str) -> str:
    """Draws named like the models' parameters, and one parameter without a prior."""
    return f"""
    SELECT 'included' || {_RUN} AS run_id,
           CASE WHEN p < 16 THEN 'logit_surv_raw[' || CAST(CAST(floor(p / 8) AS INTEGER) + 1 AS STRING) || ','
                     || CAST(p % 8 + 1 AS STRING) || ']'
                WHEN p < 32 THEN 'log_fert_sub_raw[' || CAST(CAST(floor((p - 16) / 4) AS INTEGER) + 1 AS STRING) || ','
                     || CAST((p - 16) % 4 + 1 AS STRING) || ']'
                WHEN p = 32 THEN 'sigma_surv' WHEN p = 33 THEN 'sigma_fert'
                WHEN p < 42 THEN 'log_pop_mig_init_total[' || CAST(p - 33 AS STRING) || ']'
                WHEN p < 50 THEN 'pop_0_true[' || CAST(p - 41 AS STRING) || ']'
                WHEN p < 58 THEN 'gamma_dirichlet[' || CAST(p - 49 AS STRING) || ']'
                ELSE 'log_lik[' || CAST(p - 57 AS STRING) || ']' END AS variable,
           {_CHAIN} AS chain, {_ITER} AS iteration,
           CASE WHEN p < 32 THEN x WHEN p = 32 THEN abs(x) WHEN p = 33 THEN x + 0.25
                WHEN p < 42 THEN 4 + x WHEN p < 50 THEN 100 + 100 * x
                WHEN p < 58 THEN 10 * abs(x) + 0.5 ELSE x END AS value
    FROM ({_exploded(d)}) e"""


def v_events(d: str) -> str:
    t = partial(_t, d)
    return f"""
    SELECT 'events' AS run_id, event_type AS variable,
           CAST(event_id % 4 AS INTEGER) + 1 AS chain, value
    FROM {t('events')}"""


def v_event_chain(d: str) -> str:
    """Events as one long chain per type: five variables own the whole table."""
    t = partial(_t, d)
    return f"""
    SELECT 'events' AS run_id, event_type AS variable, 1 AS chain, event_id AS iteration, value
    FROM {t('events')}"""


def v_region_person(d: str) -> str:
    """Persons with their region and age."""
    t = partial(_t, d)
    return f"""
    SELECT n.n_name AS region, l.l_quantity AS age
    FROM {t('lineitem')} l
    JOIN {t('orders')} o ON l.l_orderkey = o.o_orderkey
    JOIN {t('customer')} c ON o.o_custkey = c.c_custkey
    JOIN {t('nation')} n ON c.c_nationkey = n.n_nationkey"""


def v_region_edges(d: str) -> str:
    """Age edges of every region: steps of 5, 10 or 15 years, from 0 or 10, the top group open in some."""
    t = partial(_t, d)
    ages = (f"{t('nation')} LATERAL VIEW explode(sequence(0, 45, 5)) e AS age" if d.startswith("spark")
            else f"(SELECT *, unnest(generate_series(0, 45, 5)) AS age FROM {t('nation')}) x")
    return f"""
    SELECT n_name AS region, CAST(age AS DOUBLE) AS edge FROM {ages}
    WHERE age % (5 * (1 + n_nationkey % 3)) = 0 AND age >= 10 * (n_nationkey % 2)
    UNION ALL SELECT n_name, CAST('Infinity' AS DOUBLE) FROM {t('nation')} WHERE n_nationkey % 4 <> 0"""


def v_rows(d: str) -> str:
    """One embeddings row = one posterior draw of one population."""
    t = partial(_t, d)
    return f"""
    SELECT 'NATION_' || CAST(label AS STRING) AS region, vec_id AS draw,
           {_CHAIN} AS chain, {_ITER} AS iteration, embedding
    FROM {t('embeddings')}"""


RATE_VIEWS = ("v_life", "v_fert_wide", "v_pop_wide", "v_pop_wide_proj")

FIXTURES = {
    "v_rate_base": (v_rate_base, ("lineitem", "orders", "customer", "nation")),
    "v_life": (v_life, ("lineitem", "orders", "customer", "nation")),
    "v_fert_wide": (v_fert_wide, ("lineitem", "orders", "customer", "nation")),
    "v_pop_wide": (v_pop_wide, ("lineitem", "orders", "customer", "nation")),
    "v_pop_wide_proj": (v_pop_wide_proj, ("lineitem", "orders", "customer", "nation")),
    "v_person": (v_person, ("lineitem",)),
    "v_household": (v_household, ("lineitem",)),
    "v_band": (v_band, ("part",)),
    "v_list": (v_list, ("nation",)),
    "v_draws1": (v_draws1, ("embeddings",)),
    "v_draws2": (v_draws2, ("embeddings",)),
    "v_draws3": (v_draws3, ("embeddings",)),
    "v_params": (v_params, ("embeddings",)),
    "v_events": (v_events, ("events",)),
    "v_event_chain": (v_event_chain, ("events",)),
    "v_region_person": (v_region_person, ("lineitem", "orders", "customer", "nation")),
    "v_region_edges": (v_region_edges, ("nation",)),
    "v_rows": (v_rows, ("embeddings",)),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str, base: DataFrame | None = None) -> DataFrame:
    """Render a fixture view for Spark over the parquet tables in ``sf_dir``.

    Rate views given a materialised ``base`` (the shared aggregate, see
    ``v_rate_base``) are rendered over it instead of the driver tables.
    """
    builder, deps = FIXTURES[name]
    if base is not None and name in RATE_VIEWS:
        return spark.sql(builder("spark_base"), agg=base)
    frames = {t: read_table(spark, sf_dir, t) for t in deps}
    return spark.sql(builder("spark"), **frames)


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixture views for DuckDB."""
    parts = [f"{n} AS ({FIXTURES[n][0]('duck')})" for n in names]
    return "WITH " + ",\n".join(parts)
