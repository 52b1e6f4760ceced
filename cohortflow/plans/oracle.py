"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark operators: plain SQL over the same
fixture views. Doubles are rounded to 6 decimals, as on the Spark side.
"""

from __future__ import annotations

from ..operators.draws import DEFAULT_PROBS, quantile_name
from ..sources.fixtures import POP_BANDS, FERT_BANDS, duck_cte

O: dict[str, str] = {}

LEAD_YEAR = r"CAST(TRY_CAST(regexp_extract(period, '^(.+?)[\-]', 1) AS DOUBLE) AS INTEGER)"


def r6(expr: str, name: str) -> str:
    # + 0.0 turns a rounded -0.0 into 0.0 (Spark's round never yields -0.0)
    return f"round({expr}, 6) + 0.0e0 AS {name}"


# survival ratios (E1, W2, B10) as CTEs named life, g, surv_all, surv
SURV = f"""
life AS (SELECT region, {LEAD_YEAR} AS year,
                CASE WHEN age = 1 THEN 0 ELSE age END AS age,
                TRY_CAST(Lx AS DOUBLE) AS Lx FROM v_life),
g AS (SELECT region, year, age, CASE WHEN count(Lx) = count(*) THEN sum(Lx) END AS Lx
      FROM life GROUP BY region, year, age),
surv_all AS (SELECT region, year, age, Lx,
                    lead(Lx) OVER (PARTITION BY region, year ORDER BY age) / Lx AS surv FROM g),
surv AS (SELECT * FROM surv_all WHERE surv IS NOT NULL),
ydim AS (SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS number, value
         FROM (SELECT DISTINCT CAST(year AS INTEGER) AS value FROM surv WHERE year IS NOT NULL)),
adim AS (SELECT CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS number, value
         FROM (SELECT DISTINCT CAST(age AS INTEGER) AS value FROM surv WHERE age IS NOT NULL
               UNION ALL SELECT max(CAST(age AS INTEGER)) + 5 FROM surv))"""


def summ(view: str, probs=(0.05, 0.5, 0.95), name: str = "summ") -> str:
    qs = ", ".join(f"quantile_cont(value, {p}) AS {quantile_name(p)}" for p in probs)
    return (f"{name} AS (SELECT run_id, variable, avg(value) AS mean, stddev_samp(value) AS sd, {qs} "
            f"FROM {view} GROUP BY run_id, variable)")


IDX1 = r"TRY_CAST(regexp_extract(variable, '\[([0-9]+)', 1) AS INTEGER)"


def idx(i: int) -> str:
    return (rf"TRY_CAST(string_split(regexp_extract(variable, '\[([0-9,]+)\]$', 1), ',')[{i}] AS INTEGER)")


def qcols(probs=(0.05, 0.5, 0.95), prefix: str = "") -> str:
    return ", ".join(r6(prefix + quantile_name(p), quantile_name(p)) for p in probs)


# ------------------------------------------------------------ slice 1

O["scenario_report"] = f"""
{duck_cte('v_life', 'v_draws1')}, {SURV}, {summ('v_draws1')},
ex AS (SELECT *, {IDX1} AS idx FROM summ WHERE regexp_matches(variable, 'total_pop'))
SELECT run_id AS survey, CAST(coalesce(d.value, ex.idx) AS INTEGER) AS year,
       {r6('mean', 'mean')}, {r6('q5', 'q5')}, {r6('q50', 'median')}, {r6('q95', 'q95')}
FROM ex LEFT JOIN ydim d ON d.number = ex.idx
ORDER BY survey, year"""

_ALLQ = ", ".join(r6(quantile_name(p), quantile_name(p)) for p in DEFAULT_PROBS)

O["summarise_draws"] = f"""
{duck_cte('v_draws2')}, {summ('v_draws2', DEFAULT_PROBS)}
SELECT run_id, variable, {r6('mean', 'mean')}, {r6('sd', 'sd')}, {_ALLQ} FROM summ"""

O["summarise_events"] = f"""
{duck_cte('v_events')}, {summ('v_events', DEFAULT_PROBS)}
SELECT run_id, variable, {r6('mean', 'mean')}, {r6('sd', 'sd')}, {_ALLQ} FROM summ"""


# ------------------------------------------------------------ slice 2

_STATS = f"{r6('mean', 'mean')}, {r6('sd', 'sd')}, {qcols()}"

O["extract_indexed_1"] = f"""
{duck_cte('v_life', 'v_draws1')}, {SURV}, {summ('v_draws1')},
ex AS (SELECT *, {IDX1} AS idx FROM summ WHERE regexp_matches(variable, 'total_pop'))
SELECT run_id, variable, CAST(coalesce(d.value, ex.idx) AS INTEGER) AS year, {_STATS}
FROM ex LEFT JOIN ydim d ON d.number = ex.idx"""

O["extract_indexed_2"] = f"""
{duck_cte('v_life', 'v_draws2')}, {SURV}, {summ('v_draws2')},
ex AS (SELECT *, {idx(1)} AS i1, {idx(2)} AS i2 FROM summ WHERE regexp_matches(variable, '^fert\\['))
SELECT run_id, CAST(coalesce(y.value, i1) AS INTEGER) AS year, CAST(coalesce(a.value, i2) AS INTEGER) AS age,
       {_STATS}
FROM ex LEFT JOIN ydim y ON y.number = i1 LEFT JOIN adim a ON a.number = i2"""

O["extract_indexed_3"] = f"""
{duck_cte('v_life', 'v_draws3')}, {SURV}, {summ('v_draws3')},
ex AS (SELECT *, {idx(1)} AS i1, {idx(2)} AS i2, {idx(3)} AS i3 FROM summ
       WHERE regexp_matches(variable, '^pop_mig_true\\['))
SELECT run_id, CAST(coalesce(m.value, i1) AS INTEGER) AS mig_year,
       CAST(coalesce(y.value, i2) AS INTEGER) AS year, CAST(coalesce(a.value, i3) AS INTEGER) AS age,
       {_STATS}
FROM ex LEFT JOIN ydim m ON m.number = i1 LEFT JOIN ydim y ON y.number = i2
        LEFT JOIN adim a ON a.number = i3"""

O["extract_unmapped"] = f"""
{duck_cte('v_draws2')}, {summ('v_draws2')}
SELECT run_id, variable, {idx(1)} AS t, {idx(2)} AS a, {_STATS}
FROM summ WHERE regexp_matches(variable, '^fert_sub\\[')"""

O["population_parts"] = f"""
{duck_cte('v_life', 'v_draws1')}, {SURV}, {summ('v_draws1')},
ex AS (SELECT *, {IDX1} AS idx,
              CASE WHEN regexp_matches(variable, 'total_pop\\[') THEN 'all'
                   WHEN regexp_matches(variable, 'total_native_pop') THEN 'native-born'
                   WHEN regexp_matches(variable, 'total_mig_pop') THEN 'migrant' END AS population
       FROM summ)
SELECT run_id, population, CAST(coalesce(d.value, idx) AS INTEGER) AS year,
       {r6('mean', 'mean')}, {qcols()}
FROM ex LEFT JOIN ydim d ON d.number = ex.idx WHERE population IS NOT NULL"""

O["migration_detail"] = f"""
{duck_cte('v_life', 'v_draws3')}, {SURV}, {summ('v_draws3')},
ex AS (SELECT *, {idx(1)} AS i1, {idx(2)} AS i2, {idx(3)} AS i3 FROM summ
       WHERE regexp_matches(variable, '^pop_mig_true\\[')),
lab AS (SELECT run_id, CAST(coalesce(m.value, i1) AS INTEGER) AS mig_year,
               CAST(coalesce(y.value, i2) AS INTEGER) AS year, CAST(coalesce(a.value, i3) AS INTEGER) AS age,
               q5, q50, q95
        FROM ex LEFT JOIN ydim m ON m.number = i1 LEFT JOIN ydim y ON y.number = i2
                LEFT JOIN adim a ON a.number = i3)
SELECT run_id, mig_year, year, age, {qcols()},
       'Mig. year: ' || CAST(mig_year AS VARCHAR) AS mig_label, 't = ' || CAST(year AS VARCHAR) AS year_label
FROM lab WHERE year >= mig_year AND mig_year < 1985"""

O["migration_inflow"] = f"""
{duck_cte('v_life', 'v_draws3')}, {SURV},
ix AS (SELECT *, string_split(regexp_extract(variable, '\\[([0-9,]+)\\]$', 1), ',') AS ix FROM v_draws3
       WHERE regexp_extract(variable, '^([^\\[]+)', 1) = 'pop_mig_true'),
tot AS (SELECT run_id, 'pop_mig_init_total[' || CAST(TRY_CAST(ix[1] AS INTEGER) AS VARCHAR) || ']' AS variable,
               chain, iteration, sum(value) AS value
        FROM ix WHERE TRY_CAST(ix[1] AS INTEGER) = TRY_CAST(ix[2] AS INTEGER)
        GROUP BY ALL),
alld AS (SELECT run_id, variable, chain, iteration, value FROM v_draws3
         UNION ALL SELECT * FROM tot
         UNION ALL SELECT run_id, 'log_' || variable, chain, iteration, ln(value) FROM tot),
{summ('alld')},
ex AS (SELECT *, {IDX1} AS idx FROM summ WHERE regexp_matches(variable, '^pop_mig_init_total'))
SELECT run_id, CAST(coalesce(d.value, idx) AS INTEGER) AS year, {_STATS}
FROM ex LEFT JOIN ydim d ON d.number = ex.idx"""


# ------------------------------------------------------------ slice 3

def _q(c: str) -> str:
    return '"' + c + '"'


def tidy_sql(view: str, bands, value: str, range_period: bool, scale: str = "",
             max_year: int | None = None, extra_ids: str = "", stops: str = r"[\-\+]") -> str:
    cols = ", ".join(_q(b) for b in bands)
    year = LEAD_YEAR if range_period else "CAST(TRY_CAST(period AS DOUBLE) AS INTEGER)"
    where = f"WHERE year <= {max_year}" if max_year is not None else ""
    return f"""SELECT * FROM (
      SELECT region{extra_ids}, {year} AS year,
             CAST(TRY_CAST(regexp_extract(band, '^(.+?){stops}', 1) AS DOUBLE) AS INTEGER) AS age,
             TRY_CAST(txt AS DOUBLE){scale} AS {value}
      FROM (UNPIVOT {view} ON {cols} INTO NAME band VALUE txt)) t {where}"""


FERT = tidy_sql("v_fert_wide", FERT_BANDS, "fert", True, " / 1000.0", 2025, stops=r"[\-]")
# both sheets, the first one winning where they overlap
STACK = """
u AS (SELECT *, 1 AS sheet FROM v_pop_wide UNION ALL BY NAME SELECT *, 2 AS sheet FROM v_pop_wide_proj),
dd AS (SELECT * EXCLUDE (Variant, Notes) FROM u
       QUALIFY row_number() OVER (PARTITION BY region, period ORDER BY sheet) = 1)"""
POP = tidy_sql("dd", POP_BANDS, "pop", False, "", 2020)

O["tidy_fertility"] = f"""
{duck_cte('v_fert_wide')}
SELECT region, year, age, {r6('fert', 'fert')} FROM ({FERT})"""

O["tidy_population"] = f"""
{duck_cte('v_pop_wide', 'v_pop_wide_proj')}, {STACK}
SELECT region, year, age, {r6('pop', 'pop')} FROM ({POP})"""

O["union_sheets"] = f"""
{duck_cte('v_pop_wide', 'v_pop_wide_proj')}, {STACK}
SELECT region, sheet, year, age, {r6('pop', 'pop')}
FROM ({tidy_sql('dd', POP_BANDS, 'pop', False, extra_ids=', sheet')})"""

O["survival_ratios"] = f"""
{duck_cte('v_life')}, {SURV}
SELECT region, year, age, {r6('Lx', 'Lx')}, {r6('surv', 'surv')} FROM surv"""

SHARES = f"""{STACK},
pop AS ({POP}),
shares AS (SELECT *, pop / CASE WHEN count(pop) OVER w = count(*) OVER w THEN sum(pop) OVER w END AS pop_prop
           FROM pop WINDOW w AS (PARTITION BY region, year))"""

O["age_shares"] = f"""
{duck_cte('v_life', 'v_pop_wide', 'v_pop_wide_proj')}, {SURV}, {SHARES}
SELECT region, year, age, {r6('pop', 'pop')}, {r6('pop_prop', 'pop_prop')} FROM shares
WHERE year IN (SELECT value FROM ydim) AND age IN (SELECT age FROM surv)"""

O["initial_age_profile"] = f"""
{duck_cte('v_pop_wide', 'v_pop_wide_proj')}, {SHARES},
f AS (SELECT *, min(year) OVER (PARTITION BY region) AS y0, max(age) OVER (PARTITION BY region) AS amax
      FROM shares)
SELECT region, CAST(row_number() OVER (PARTITION BY region ORDER BY age) AS INTEGER) AS pos, age,
       {r6('pop_prop', 'share')}
FROM f WHERE year = y0 AND age <> amax"""

O["align_fertility"] = f"""
{duck_cte('v_life', 'v_fert_wide')}, {SURV}, fert AS ({FERT})
SELECT s.region, s.year, s.age, {r6('coalesce(f.fert, 0.0)', 'fert')}
FROM surv s LEFT JOIN fert f ON f.region = s.region AND f.year = s.year AND f.age = s.age"""


# ------------------------------------------------------------ slice 4

O["age_dim"] = f"{duck_cte('v_life')}, {SURV} SELECT number, value FROM adim"
O["year_dim"] = f"{duck_cte('v_life')}, {SURV} SELECT number, value FROM ydim"
O["period_edges"] = f"""
{duck_cte('v_life')}, {SURV},
e AS (SELECT CAST(value AS DOUBLE) AS edge FROM ydim UNION ALL SELECT max(value) + 5.0 FROM ydim)
SELECT CAST(row_number() OVER (ORDER BY edge) AS INTEGER) AS pos, edge FROM e"""


# ------------------------------------------------------------ slice 4: survey counts

BINS = """
pbins AS (SELECT value AS lo, coalesce(lead(value) OVER (ORDER BY value), value + 5) AS hi,
                 lead(value) OVER (ORDER BY value) IS NULL AS is_last FROM ydim),
ages AS (SELECT DISTINCT age FROM surv),
abins AS (SELECT age AS lo, coalesce(CAST(lead(age) OVER (ORDER BY age) AS DOUBLE), 'inf'::DOUBLE) AS hi,
                 lead(age) OVER (ORDER BY age) IS NULL AS is_last FROM ages)"""


def in_bin(x: str, b: str) -> str:
    return f"{x} >= {b}.lo AND ({x} < {b}.hi OR ({b}.is_last AND {x} <= {b}.hi))"


O["count_cohort_age"] = f"""
{duck_cte('v_life', 'v_person')}, {SURV}, {BINS},
p AS (SELECT * FROM v_person WHERE basic_gender = 2
      AND year_migration_m IS NOT NULL AND age_migration_m IS NOT NULL),
b AS (SELECT CAST(pb.lo AS INTEGER) AS mig_year, CAST(ab.lo AS INTEGER) AS age FROM p
      LEFT JOIN pbins pb ON {in_bin('p.year_migration_m', 'pb')}
      LEFT JOIN abins ab ON {in_bin('p.basic_age', 'ab')}),
c AS (SELECT mig_year, age, count(*) AS n FROM b WHERE mig_year IS NOT NULL AND age IS NOT NULL
      GROUP BY mig_year, age),
grid AS (SELECT CAST(y.value AS INTEGER) AS mig_year, CAST(a.age AS INTEGER) AS age FROM ydim y, ages a)
SELECT grid.mig_year, grid.age, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid LEFT JOIN c ON c.mig_year = grid.mig_year AND c.age = grid.age"""

O["count_native_age"] = f"""
{duck_cte('v_life', 'v_person')}, {SURV}, {BINS},
p AS (SELECT * FROM v_person WHERE basic_gender = 2 AND born_kenya_m = 1),
b AS (SELECT CAST(ab.lo AS INTEGER) AS age FROM p LEFT JOIN abins ab ON {in_bin('p.basic_age', 'ab')}),
c AS (SELECT age, count(*) AS n FROM b WHERE age IS NOT NULL GROUP BY age)
SELECT CAST(a.age AS INTEGER) AS age, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM ages a LEFT JOIN c ON c.age = a.age"""

O["dropped_counts"] = f"""
{duck_cte('v_life', 'v_person')}, {SURV}, {BINS},
m AS (SELECT (SELECT count(*) FROM pbins pb WHERE {in_bin('p.year_migration_m', 'pb')}) AS y,
             (SELECT count(*) FROM abins ab WHERE {in_bin('p.basic_age', 'ab')}) AS a
      FROM v_person p WHERE basic_gender = 2 AND year_migration_m IS NOT NULL AND age_migration_m IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM abins ab WHERE {in_bin('p.basic_age', 'ab')}) AS a
      FROM v_person p WHERE basic_gender = 2 AND born_kenya_m = 1)
SELECT 'cohort_age' AS "table", CASE WHEN y = 0 AND a = 0 THEN 'both' WHEN y = 0 THEN 'year' ELSE 'age' END AS reason,
       count(*) AS n FROM m WHERE y = 0 OR a = 0 GROUP BY ALL
UNION ALL SELECT 'native_age', 'age', count(*) FROM n WHERE a = 0 HAVING count(*) > 0"""

O["unspread_bands"] = f"""
{duck_cte('v_band', 'v_list')}
SELECT age_member, count(*) AS n FROM v_band
WHERE age_member = '60+' AND (tribe IS NULL OR tribe NOT IN (SELECT tribe_name FROM v_list)) GROUP BY age_member"""

O["count_full_outer"] = f"""
{duck_cte('v_life', 'v_household')}, {SURV},
dom AS (SELECT CAST(unnest(range(0, (SELECT max(age) FROM surv) + 1, 5)) AS INTEGER) AS age),
hb AS (SELECT age AS lo, lead(age) OVER (ORDER BY age) AS hi FROM dom),
h AS (SELECT TRY_CAST(age AS DOUBLE) AS x FROM v_household WHERE gender = 2 AND age IS NOT NULL),
c AS (SELECT hb.lo AS age, count(*) AS n FROM h LEFT JOIN hb ON h.x >= hb.lo AND (hb.hi IS NULL OR h.x < hb.hi)
      GROUP BY hb.lo)
SELECT CAST(coalesce(c.age, dom.age) AS INTEGER) AS age, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM c FULL JOIN dom ON c.age = dom.age"""

O["exclude_listed"] = f"""
{duck_cte('v_band', 'v_list')}
SELECT * FROM v_band b WHERE NOT EXISTS (SELECT 1 FROM v_list l WHERE l.tribe_name = b.tribe)"""

O["restrict_to_domain"] = f"""
{duck_cte('v_life', 'v_fert_wide')}, {SURV}, fert AS ({FERT})
SELECT region, year, age, {r6('fert', 'fert')} FROM fert
WHERE year IN (SELECT value FROM ydim) AND age IN (SELECT age FROM surv)"""

BANDED = f"""
{duck_cte('v_life', 'v_band', 'v_list')}, {SURV}, {BINS},
s AS (SELECT b.* FROM v_band b
      WHERE NOT EXISTS (SELECT 1 FROM v_list l WHERE l.tribe_name = b.tribe) AND age_member IS NOT NULL)"""


def limits(src: str, keep: str) -> str:
    parts = "string_split_regex(replace(age_member, 'Below 15', '0-15'), '[^A-Za-z0-9]+')"
    return (f"SELECT {keep} n, TRY_CAST({parts}[1] AS INTEGER) AS lo, "
            f"TRY_CAST({parts}[2] AS INTEGER) AS hi FROM {src}")


O["banded_migrants"] = f"""
{BANDED},
m AS (SELECT age_member, TRY_CAST(mig AS DOUBLE) AS mig_year FROM s
      WHERE mig IS NOT NULL OR mig <> 'Non applicable'),
c AS (SELECT age_member, mig_year, count(*) AS n FROM m
      WHERE mig_year > (SELECT min(value) FROM ydim) GROUP BY age_member, mig_year),
lim AS ({limits('c', 'mig_year,')}),
sp AS (SELECT mig_year, unnest(range(lo, hi)) AS age, n / (hi - lo) AS n FROM lim WHERE hi > lo),
bn AS (SELECT CAST(pb.lo AS INTEGER) AS mig_year, CAST(ab.lo AS INTEGER) AS age, n FROM sp
       LEFT JOIN pbins pb ON {in_bin('sp.mig_year', 'pb')}
       LEFT JOIN abins ab ON {in_bin('sp.age', 'ab')}),
su AS (SELECT mig_year, age, sum(n) AS n FROM bn WHERE mig_year IS NOT NULL AND age IS NOT NULL
       GROUP BY mig_year, age),
grid AS (SELECT CAST(y.value AS INTEGER) AS mig_year, CAST(a.age AS INTEGER) AS age FROM ydim y, ages a)
SELECT grid.mig_year, grid.age, {r6('coalesce(su.n, 0.0)', 'n')}
FROM grid LEFT JOIN su ON su.mig_year = grid.mig_year AND su.age = grid.age"""

O["survival_shifted"] = f"""{duck_cte('v_life')}, {SURV}
SELECT region, year, age, {r6("coalesce(lag(surv) OVER (PARTITION BY region, year ORDER BY age), 1.0e0)", 'surv')} FROM surv"""

O["count_region_edges"] = f"""
{duck_cte('v_region_person', 'v_region_edges')},
iv AS (SELECT region, edge AS lo, lead(edge) OVER w AS hi, lead(edge, 2) OVER w IS NULL AS last
       FROM v_region_edges WINDOW w AS (PARTITION BY region ORDER BY edge))
SELECT p.region, iv.lo AS bin, count(*) AS n
FROM v_region_person p LEFT JOIN iv ON iv.region = p.region AND iv.hi IS NOT NULL AND p.age >= iv.lo
     AND (p.age < iv.hi OR (iv.last AND p.age = iv.hi))
GROUP BY p.region, iv.lo"""

O["banded_natives"] = f"""
{BANDED},
c AS (SELECT age_member, count(*) AS n FROM s
      WHERE cbirth IN ('small', 'red') AND (mig IS NOT NULL OR mig = 'Non applicable')
      GROUP BY age_member),
lim AS ({limits('c', '')}),
sp AS (SELECT unnest(range(lo, hi)) AS age, n / (hi - lo) AS n FROM lim WHERE hi > lo),
bn AS (SELECT CAST(ab.lo AS INTEGER) AS age, n FROM sp LEFT JOIN abins ab ON {in_bin('sp.age', 'ab')}),
su AS (SELECT age, sum(n) AS n FROM bn WHERE age IS NOT NULL GROUP BY age)
SELECT CAST(a.age AS INTEGER) AS age, {r6('coalesce(su.n, 0.0)', 'n')}
FROM ages a LEFT JOIN su ON su.age = a.age"""


O["banded_natives_strict"] = O["banded_natives"].replace("(mig IS NOT NULL OR mig = 'Non applicable')", "mig = 'Non applicable'") \
    .replace("unnest(range(lo, hi))", "unnest(range(lo, hi + 1))").replace("n / (hi - lo)", "n / (hi + 1 - lo)")


# ------------------------------------------------------------ slice 5: arrays and model input

O["to_matrix"] = O["count_cohort_age"].replace(
    "SELECT grid.mig_year, grid.age, CAST(coalesce(c.n, 0) AS BIGINT) AS n\nFROM grid",
    "SELECT CAST(dense_rank() OVER (ORDER BY grid.mig_year) AS INTEGER) AS row_pos,\n"
    "       CAST(dense_rank() OVER (ORDER BY grid.age) AS INTEGER) AS col_pos, grid.mig_year,\n"
    "       round(CAST(coalesce(c.n, 0) AS DOUBLE), 6) + 0.0e0 AS value\nFROM grid")

ALIGNED = f"""
fert AS ({FERT}),
af AS (SELECT s.region, s.year, s.age, coalesce(f.fert, 0.0) AS fert
       FROM surv s LEFT JOIN fert f ON f.region = s.region AND f.year = s.year AND f.age = s.age),
fl AS (SELECT region, age, bool_or(fert > 0) AS fertile FROM af GROUP BY region, age),
ix AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY age) AS idx FROM fl),
fw AS (SELECT region, count(*) AS n_ages, count(*) FILTER (WHERE fertile) AS n_fert_ages,
              min(age) FILTER (WHERE fertile) AS first_fertile_age,
              max(age) FILTER (WHERE fertile) AS last_fertile_age,
              min(idx) FILTER (WHERE fertile) - 1 AS ages_before_fert,
              count(*) - max(idx) FILTER (WHERE fertile) AS ages_after_fert
       FROM ix GROUP BY region)"""

O["fertile_window"] = f"""
{duck_cte('v_life', 'v_fert_wide')}, {SURV}, {ALIGNED}
SELECT region, CAST(n_ages AS BIGINT) AS n_ages, CAST(n_fert_ages AS BIGINT) AS n_fert_ages,
       CAST(first_fertile_age AS BIGINT) AS first_fertile_age, CAST(last_fertile_age AS BIGINT) AS last_fertile_age,
       CAST(ages_before_fert AS BIGINT) AS ages_before_fert, CAST(ages_after_fert AS BIGINT) AS ages_after_fert
FROM fw"""

O["model_input"] = f"""
{duck_cte('v_life', 'v_fert_wide')}, {SURV}, {ALIGNED},
sk AS (SELECT region, count(DISTINCT age) AS K, count(DISTINCT year) AS Time, count(*) AS surv_cells,
              sum(surv) AS surv_total FROM surv GROUP BY region),
fk AS (SELECT af.region, count(*) AS fert_cells, sum(af.fert) AS fert_total FROM af
       JOIN fl ON fl.region = af.region AND fl.age = af.age AND fl.fertile GROUP BY af.region)
SELECT sk.region, CAST(K AS BIGINT) AS K, CAST(Time AS BIGINT) AS Time,
       CAST(n_fert_ages AS BIGINT) AS n_fert_ages, CAST(ages_before_fert AS BIGINT) AS ages_before_fert,
       CAST(ages_after_fert AS BIGINT) AS ages_after_fert, {r6('1.0 / (1.0 + 1.05)', 'prop_f')},
       CAST(surv_cells AS BIGINT) AS surv_cells, {r6('surv_total', 'surv_total')},
       CAST(fert_cells AS BIGINT) AS fert_cells, {r6('fert_total', 'fert_total')}
FROM sk LEFT JOIN fk ON fk.region = sk.region LEFT JOIN fw ON fw.region = sk.region"""


O["model_input_cells"] = f"""
{duck_cte('v_life', 'v_fert_wide')}, {SURV}, {ALIGNED},
sc AS (SELECT region, 'surv' AS field, dense_rank() OVER (PARTITION BY region ORDER BY year) AS t,
              dense_rank() OVER (PARTITION BY region ORDER BY age) AS a, year, age, surv AS value FROM surv),
fc AS (SELECT af.region, 'fert' AS field, dense_rank() OVER (PARTITION BY af.region ORDER BY year) AS t,
              dense_rank() OVER (PARTITION BY af.region ORDER BY af.age) AS a, year, af.age, af.fert AS value
       FROM af JOIN fl ON fl.region = af.region AND fl.age = af.age AND fl.fertile)
SELECT region, field, CAST(t AS INTEGER) AS t, CAST(a AS INTEGER) AS a, CAST(year AS INTEGER) AS year,
       CAST(age AS INTEGER) AS age, {r6('value', 'value')} FROM (SELECT * FROM sc UNION ALL SELECT * FROM fc)"""

O["missing_cells"] = f"""
{duck_cte('v_life')}, {SURV}
SELECT y.region, y.year, a.age FROM (SELECT DISTINCT region, year FROM surv) y
JOIN (SELECT DISTINCT region, age FROM surv) a ON a.region = y.region
WHERE NOT EXISTS (SELECT 1 FROM surv s WHERE s.region = y.region AND s.year = y.year AND s.age = a.age)"""


# ------------------------------------------------------------ slice 6: diagnostics

from ..functions.scalar import norm_ppf_sql  # noqa: E402

_P = "PARTITION BY run_id, variable"
SPLIT = f"""
c AS (SELECT *, row_number() OVER ({_P}, chain ORDER BY iteration) AS r,
             count(*) OVER ({_P}, chain) AS nc,
             dense_rank() OVER ({_P} ORDER BY chain) AS ci,
             quantile_cont(value, 0.5) OVER ({_P}) AS med,
             quantile_cont(value, 0.05) OVER ({_P}) AS q05,
             quantile_cont(value, 0.95) OVER ({_P}) AS q95,
             min(value) OVER ({_P}) = max(value) OVER ({_P}) AS is_const
      FROM dr),
sp AS (SELECT run_id, variable, value, med, q05, q95, is_const,
              CASE WHEN r <= floor(nc / 2) THEN 2 * ci - 1 ELSE 2 * ci END AS sc,
              CASE WHEN r <= floor(nc / 2) THEN r ELSE r - (nc - floor(nc / 2)) END AS pos
       FROM c WHERE r <= floor(nc / 2) OR r > nc - floor(nc / 2)),
rk AS (SELECT *, abs(value - med) AS fold, count(*) OVER ({_P}) AS S FROM sp),
rk2 AS (SELECT *,
          (rank() OVER ({_P} ORDER BY value)
           + count(*) OVER ({_P} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 AS rb,
          (rank() OVER ({_P} ORDER BY fold)
           + count(*) OVER ({_P} ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 AS rf
        FROM rk),
zz AS (SELECT *, {norm_ppf_sql('(rb - 0.375) / (S + 0.25)')} AS z,
                 {norm_ppf_sql('(rf - 0.375) / (S + 0.25)')} AS zf FROM rk2)"""

O["rhat"] = f"""
{duck_cte('v_draws1')}, dr AS (SELECT * FROM v_draws1), {SPLIT},
pc AS (SELECT run_id, variable, sc, count(*) AS n, avg(z) AS mz, var_samp(z) AS vz,
              avg(zf) AS mf, var_samp(zf) AS vf, bool_or(is_const) AS cst
       FROM zz GROUP BY run_id, variable, sc),
rh AS (SELECT run_id, variable,
              sqrt((max(n) * var_samp(mz) / avg(vz) + max(n) - 1) / max(n)) AS rb,
              sqrt((max(n) * var_samp(mf) / avg(vf) + max(n) - 1) / max(n)) AS rf,
              bool_or(cst) AS cst
       FROM pc GROUP BY run_id, variable)
SELECT run_id, variable, round(CASE WHEN cst THEN NULL ELSE greatest(rb, rf) END, 6) + 0.0e0 AS rhat FROM rh"""

_K = "run_id, variable, series"
ESS = f"""
{duck_cte('v_draws1')}, dr AS (SELECT * FROM v_draws1), {SPLIT},
ser AS (SELECT run_id, variable, sc, pos, 'bulk' AS series, z AS x FROM zz
        UNION ALL SELECT run_id, variable, sc, pos, 'q05', CAST(value <= q05 AS DOUBLE) FROM zz
        UNION ALL SELECT run_id, variable, sc, pos, 'q95', CAST(value <= q95 AS DOUBLE) FROM zz),
cm AS (SELECT {_K}, sc, avg(x) AS cm, count(*) AS n FROM ser GROUP BY {_K}, sc),
sx AS (SELECT s.*, cm.cm, cm.n FROM ser s JOIN cm USING ({_K}, sc)),
ac AS (SELECT a.run_id, a.variable, a.series, a.sc, b.pos - a.pos AS t,
              sum((a.x - a.cm) * (b.x - b.cm)) / max(a.n) AS acov
       FROM sx a JOIN sx b ON a.run_id = b.run_id AND a.variable = b.variable AND a.series = b.series
                          AND a.sc = b.sc AND b.pos >= a.pos
       GROUP BY a.run_id, a.variable, a.series, a.sc, b.pos - a.pos),
lagm AS (SELECT {_K}, t, avg(acov) AS A FROM ac GROUP BY {_K}, t),
base AS (SELECT a.run_id, a.variable, a.series, avg(a.acov) AS acov0, count(*) AS m, max(cm.n) AS n,
                var_samp(cm.cm) AS vmean, max(cm.cm) - min(cm.cm) AS spread, max(a.acov) AS maxvar
         FROM ac a JOIN cm USING ({_K}, sc) WHERE a.t = 0 GROUP BY a.run_id, a.variable, a.series),
b2 AS (SELECT *, acov0 * n / (n - 1) AS mean_var,
              acov0 + CASE WHEN m > 1 THEN vmean ELSE 0 END AS var_plus,
              spread = 0 AND maxvar = 0 AS flat FROM base),
rho AS (SELECT l.*, b2.n, b2.m, b2.flat,
               CASE WHEN l.t = 0 THEN 1.0e0 ELSE 1 - (b2.mean_var - l.A) / b2.var_plus END AS rho
        FROM lagm l JOIN b2 USING ({_K})),
pr AS (SELECT {_K}, CAST(floor(t / 2) AS INTEGER) AS k, sum(rho) AS P,
              max(CASE WHEN t % 2 = 0 THEN rho END) AS even, max(n) AS n, max(m) AS m, bool_or(flat) AS flat
       FROM rho GROUP BY {_K}, CAST(floor(t / 2) AS INTEGER) HAVING count(*) = 2),
pr2 AS (SELECT *,
          least(coalesce(min(CASE WHEN P IS NULL OR isnan(P) OR P <= 0 THEN k END) OVER w,
                         greatest(0, ceil((n - 5) / 2))), greatest(0, ceil((n - 5) / 2))) AS kstop,
          min(P) OVER (w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS runmin
        FROM pr WINDOW w AS (PARTITION BY {_K})),
tau AS (SELECT {_K}, sum(CASE WHEN k < kstop THEN runmin ELSE 0 END) AS s,
               max(CASE WHEN k = kstop THEN (CASE WHEN P >= 0 THEN even WHEN even > 0 THEN even ELSE 0 END) END)
                 AS last, max(n) AS n, max(m) AS m, bool_or(flat) AS flat
        FROM pr2 GROUP BY {_K}),
es AS (SELECT {_K}, CASE WHEN NOT flat AND n >= 3
                    THEN n * m / greatest(-1 + 2 * s + coalesce(last, 0), 1 / log10(n * m)) END AS ess FROM tau),
fl AS (SELECT run_id, variable, bool_or(is_const) AS cst FROM zz GROUP BY run_id, variable),
wide AS (SELECT run_id, variable, max(CASE WHEN series = 'bulk' THEN ess END) AS eb,
                max(CASE WHEN series = 'q05' THEN ess END) AS el, max(CASE WHEN series = 'q95' THEN ess END) AS eh
         FROM es GROUP BY run_id, variable)"""

O["unequal_chains"] = f"""
{duck_cte('v_draws1', 'v_events')},
n AS (SELECT run_id, variable, chain, count(*) AS n
      FROM (SELECT run_id, variable, chain FROM v_draws1 UNION ALL SELECT run_id, variable, chain FROM v_events) GROUP BY ALL)
SELECT run_id, variable, min(n) AS shortest, max(n) AS longest FROM n GROUP BY run_id, variable
HAVING floor(min(n) / 2) <> floor(max(n) / 2)"""

O["ess_bulk"] = f"""{ESS}
SELECT w.run_id, w.variable, round(CASE WHEN fl.cst THEN NULL ELSE eb END, 6) + 0.0e0 AS ess_bulk
FROM wide w JOIN fl USING (run_id, variable)"""

O["ess_tail"] = f"""{ESS}
SELECT w.run_id, w.variable,
       round(CASE WHEN fl.cst OR el IS NULL OR eh IS NULL THEN NULL ELSE least(el, eh) END, 6) + 0.0e0 AS ess_tail
FROM wide w JOIN fl USING (run_id, variable)"""


_EVENT_CHAIN = [(f"{duck_cte('v_draws1')}, dr AS (SELECT * FROM v_draws1)",
                 f"{duck_cte('v_event_chain')}, dr AS (SELECT * FROM v_event_chain)")]


def _on_events(sql: str) -> str:
    for old, new in _EVENT_CHAIN:
        assert old in sql
        sql = sql.replace(old, new)
    return sql


O["convergence_events"] = f"""
SELECT r.run_id, r.variable, r.rhat, b.ess_bulk, t.ess_tail
FROM ({_on_events(O['rhat'])}) r LEFT JOIN ({_on_events(O['ess_bulk'])}) b USING (run_id, variable)
     LEFT JOIN ({_on_events(O['ess_tail'])}) t USING (run_id, variable)"""


# ------------------------------------------------------------ slice 7: cohort operators
# The same arithmetic as the array operators, written with DuckDB list
# lambdas; folds use list_reduce with an initial value.

def _e(i: str) -> str:
    return f"CAST(embedding[(({i}) % 64) + 1] AS DOUBLE)"


def _vec(n: str, off: int, scale: str = "4.0e0", shift: str = "0.0e0") -> str:
    return f"list_transform(generate_series(1, {n}), lambda a: {shift} + {scale} * {_e(f'{off} + a - 1')})"


def _mat(rows: str, cols: str, off: int, scale: str = "4.0e0", shift: str = "0.0e0") -> str:
    return (f"list_transform(generate_series(1, {rows}), lambda t: list_transform(generate_series(1, {cols}), "
            f"lambda a: {shift} + {scale} * {_e(f'{off} + (t - 1) * {cols} + a - 1')}))")


def _sum(lst: str) -> str:
    return f"list_reduce({lst}, lambda x, y: x + y, 0.0e0)"


def _dot(a: str, b: str) -> str:
    return _sum(f"list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])")


def _step(pop: str, s: str, r: str | None) -> str:
    births = _dot(r, pop) if r else "0.0e0"
    return (f"list_transform(generate_series(1, len({pop})), lambda a: CASE WHEN a = 1 THEN {births} "
            f"ELSE {s}[a] * {pop}[a - 1] + CASE WHEN a = len({pop}) THEN {s}[len({pop}) + 1] * {pop}[len({pop})] "
            f"ELSE 0.0e0 END END)")


def _softmax(v: str) -> str:
    ex = f"list_transform({v}, lambda x: exp(x - list_max({v})))"
    return f"list_transform({ex}, lambda x: x / {_sum(ex)})"


def _shares_softmax(raw: str, props: str, sd: str) -> str:
    lr = f"list_transform({props}, lambda v: ln(v / {props}[10]))"
    return _softmax(f"list_transform(list_zip({raw}, {lr}), lambda z: z[1] * {sd} + z[2])")


def _fold(pop0: str, T: str, body: str) -> str:
    """list_reduce over t = 2..T of concat(acc, [body(acc[-1], t)])."""
    return (f"list_reduce(generate_series(2, greatest({T}, 2)), lambda acc, t: CASE WHEN t <= {T} "
            f"THEN list_concat(acc, [{body}]) ELSE acc END, [{pop0}])")


SHARES_U = f"""
upop AS ({tidy_sql('dd', POP_BANDS, 'pop', False, extra_ids=', sheet')}),
ushares AS (SELECT *, pop / CASE WHEN count(pop) OVER w = count(*) OVER w THEN sum(pop) OVER w END AS pop_prop
            FROM upop WINDOW w AS (PARTITION BY region, year))"""

DRAWS = f"""
{duck_cte('v_life', 'v_fert_wide', 'v_pop_wide', 'v_pop_wide_proj', 'v_rows')}, {SURV}, {ALIGNED}, {SHARES}, {SHARES_U},
sm AS (SELECT region, list(r ORDER BY year) AS surv_mean, count(*) AS T
       FROM (SELECT region, year, list(surv ORDER BY age) AS r FROM surv GROUP BY region, year) GROUP BY region),
kk AS (SELECT region, count(DISTINCT age) AS K FROM surv GROUP BY region),
fm AS (SELECT region, list(r ORDER BY year) AS fert_mean
       FROM (SELECT af.region, af.year,
                    coalesce(list(af.fert ORDER BY af.age) FILTER (WHERE fl.fertile), []) AS r
             FROM af JOIN fl ON fl.region = af.region AND fl.age = af.age
             GROUP BY af.region, af.year) GROUP BY region),
prof AS (SELECT region, list(pop_prop ORDER BY age) AS profile
         FROM (SELECT *, min(year) OVER (PARTITION BY region) AS y0, max(age) OVER (PARTITION BY region) AS amax
               FROM shares) WHERE year = y0 AND age <> amax GROUP BY region),
mp AS (SELECT region, list(r ORDER BY year) AS mig_props
       FROM (SELECT s.region, s.year, list(u.pop_prop ORDER BY s.age) AS r
             FROM surv s LEFT JOIN ushares u ON u.region = s.region AND u.year = s.year AND u.age = s.age
             GROUP BY s.region, s.year) GROUP BY region),
pa AS (SELECT v.region, v.draw, v.embedding, kk.K, sm.T, 1.0e0 / (1.0e0 + 1.05e0) AS prop_f,
              fw.n_fert_ages AS nf, fw.ages_before_fert AS bf, fw.ages_after_fert AS aft,
              sm.surv_mean, fm.fert_mean, prof.profile, mp.mig_props
       FROM v_rows v JOIN sm ON sm.region = v.region JOIN kk ON kk.region = v.region
       LEFT JOIN fm ON fm.region = v.region LEFT JOIN fw ON fw.region = v.region
       LEFT JOIN prof ON prof.region = v.region LEFT JOIN mp ON mp.region = v.region),
pb AS (SELECT *, abs({_e('0')}) AS sigma_surv, abs({_e('1')}) AS sigma_fert, 100.0e0 * (abs({_e('2')}) + 1.0e0) AS sigma_pop,
              {_mat('T', 'K', 3)} AS logit_surv_raw, {_mat('T', 'nf', 5)} AS log_fert_sub_raw,
              4.0e0 * {_e('7')} AS log_pop_0_total_true_raw, {_vec('K', 9)} AS log_pop_0_ratios_raw,
              list_transform(generate_series(1, K), lambda a: exp({_e('11 + a - 1')})) AS gamma_dirichlet,
              {_vec('T', 13, shift='4.0e0')} AS log_pop_mig_init_total,
              {_mat('T', 'K', 17)} AS log_pop_mig_init_ratios
       FROM pa),
pc AS (SELECT *,
         list_transform(surv_mean, lambda row, t: list_concat(
             list_transform(list_zip(row, logit_surv_raw[t]),
                            lambda z: 1.0e0 / (1.0e0 + exp(-(ln(z[1] / (1.0e0 - z[1])) + z[2] * sigma_surv)))),
             [0.0e0])) AS surv,
         list_transform(fert_mean, lambda row, t: list_concat(list_concat(
             list_transform(generate_series(1, bf), lambda i: 0.0e0),
             list_transform(list_zip(row, log_fert_sub_raw[t]), lambda z: exp(ln(z[1]) + z[2] * sigma_fert))),
             list_transform(generate_series(1, aft + 1), lambda i: 0.0e0))) AS fert
       FROM pb),
pd AS (SELECT *,
         list_transform(surv, lambda s, t: list_transform(generate_series(1, len(s) - 1),
             lambda a: 2.5e0 * s[1] * prop_f * (fert[t][a] + fert[t][a + 1] * s[a + 1]))) AS reprod
       FROM pc)"""


def long2(src: str, col: str, names=("t", "a"), value: str = "value") -> str:
    return (f"SELECT region, draw, CAST(t AS INTEGER) AS {names[0]}, CAST(a AS INTEGER) AS {names[1]}, "
            f"round(v, 6) + 0.0e0 AS {value} FROM (SELECT region, draw, t, generate_subscripts(row, 1) AS a, unnest(row) AS v "
            f"FROM (SELECT region, draw, generate_subscripts({col}, 1) AS t, unnest({col}) AS row FROM {src}))")


O["survival_from_draw"] = f"{DRAWS}\n{long2('pd', 'surv')}"
O["fertility_from_draw"] = f"{DRAWS}\n{long2('pd', 'fert')}"
O["reproduction_row"] = f"{DRAWS}\n{long2('pd', 'reprod')}"

O["leslie_entries"] = f"""{DRAWS},
le AS (SELECT region, draw, generate_subscripts(surv, 1) AS t, unnest(surv) AS s, unnest(reprod) AS r FROM pd),
ent AS (SELECT region, draw, t, 1 AS row, a AS col, r[a] AS value
          FROM (SELECT *, unnest(generate_series(1, len(r))) AS a FROM le)
        UNION ALL SELECT region, draw, t, a, a - 1, s[a]
          FROM (SELECT *, unnest(generate_series(2, len(r))) AS a FROM le)
        UNION ALL SELECT region, draw, t, len(r), len(r), s[len(r) + 1] FROM le)
SELECT region, draw, CAST(t AS INTEGER) AS t, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col,
       round(value, 6) + 0.0e0 AS value FROM ent"""

O["leslie_no_births"] = f"SELECT * FROM ({O['leslie_entries']}) WHERE row > 1"

_PRODUCT = """SELECT l.region, l.draw, l.t0, l.row, r.col, sum(l.value * r.value) AS value
  FROM ent l JOIN {right} r ON l.region = r.region AND l.draw = r.draw AND l.t0 = r.t0 AND l.col = r.row
  WHERE l.j = {j} GROUP BY ALL"""
O["leslie_product"] = O["leslie_entries"].replace("\nSELECT region, draw, CAST(t AS INTEGER) AS t, CAST(row", """,
ent2 AS (SELECT region, draw, CAST(floor((t - 1) / 4) * 4 AS INTEGER) AS t0, (t - 1) % 4 AS j, row, col, value FROM ent),
p1 AS (SELECT region, draw, t0, row, col, value FROM ent2 WHERE j = 0),
""" + ",\n".join(f"p{j + 1} AS ({_PRODUCT.format(right=f'p{j}', j=j).replace('FROM ent l', 'FROM ent2 l')})" for j in (1, 2, 3)) + """
SELECT region, draw, t0, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(value, 6) + 0.0e0 AS value FROM p4
--SELECT region, draw, CAST(t AS INTEGER) AS t, CAST(row""")
O["leslie_product"] = O["leslie_product"].split("\n--")[0]

_LN_POP0 = (f"list_transform({_shares_softmax('log_pop_0_ratios_raw', 'profile', '1.0e0')}, "
            f"lambda x: x * exp(7.0e0 + 0.7e0 * log_pop_0_total_true_raw))")
_DIR_POP0 = ("list_transform(list_transform(gamma_dirichlet, lambda x: x / "
             f"{_sum('gamma_dirichlet')}), lambda x: x * exp(7.0e0 + 0.7e0 * log_pop_0_total_true_raw))")

O["project_closed"] = f"""{DRAWS},
pp AS (SELECT region, draw, {_fold(_LN_POP0, 'len(surv)', _step('acc[-1]', 'surv[t - 1]', 'reprod[t - 1]'))} AS pop
       FROM pd)
{long2('pp', 'pop', value='pop')}"""

O["project_sparse"] = O["project_closed"]

O["project_closed_t"] = f"""{DRAWS},
pp AS (SELECT region, draw, {_fold(_DIR_POP0, 'len(surv)', _step('acc[-1]', 'surv[t]', 'reprod[t]'))} AS pop
       FROM pd)
{long2('pp', 'pop', value='pop')}"""

_TOT = ("list_transform(list_transform(log_pop_mig_init_total, lambda v: exp(v)), "
        "lambda v, i: CASE WHEN 15 > 0 AND i > 15 THEN 0.0e0 ELSE v END)")
_TOBS_MIG = ("CASE WHEN CAST(regexp_extract(region, '([0-9]+)$', 1) AS INTEGER) % 10 = 0 THEN [0] "
             "WHEN CAST(regexp_extract(region, '([0-9]+)$', 1) AS INTEGER) % 10 = 5 THEN [12, 15] ELSE [15] END")
_TOT_OBS = _TOT.replace("15", "t_obs[-1]")
_SH = "list_transform(list_zip(log_pop_mig_init_ratios, mig_props), lambda z: " + \
      _shares_softmax("z[1]", "z[2]", "5.0e0") + ")"
_START = "list_transform(sh[m], lambda x: x * tot[m])"
_ZERO_K = f"list_transform({_START}, lambda x: 0.0e0)"
_COH = ("list_transform(generate_series(1, len(tot)), lambda m: " +
        _fold(f"CASE WHEN m = 1 THEN {_START} ELSE {_ZERO_K} END", "len(tot)",
              f"CASE WHEN t < m THEN {_ZERO_K} WHEN t = m THEN {_START} ELSE "
              f"{_step('acc[-1]', 'surv[t - 1]', None)} END") + ")")

DISAGG = f"""{DRAWS},
dg AS (SELECT *, {_TOT} AS tot, {_SH} AS sh FROM pd),
dc AS (SELECT *, {_COH} AS cohorts FROM dg),
db AS (SELECT *, list_transform(generate_series(1, len(reprod)), lambda t: CASE WHEN t = 1 THEN 0.0e0 ELSE
         list_reduce(cohorts, lambda acc, c: acc + {_dot('reprod[t - 1]', 'c[t - 1]')}, 0.0e0) END) AS births
       FROM dc),
dn AS (SELECT *, {_fold('list_transform(generate_series(1, K), lambda i: 0.0e0)', 'len(births)',
                        "list_transform(" + _step('acc[-1]', 'surv[t - 1]', 'reprod[t - 1]')
                        + ", lambda v, i: v + CASE WHEN i = 1 THEN births[t] ELSE 0.0e0 END)")} AS native
       FROM db)"""

O["project_migrants"] = f"""{DISAGG},
ct AS (SELECT region, draw, list_transform(cohorts, lambda c: list_transform(c, lambda p: {_sum('p')})) AS ct FROM dn)
{long2('ct', 'ct', ('mig_year', 't'), 'pop')}"""

O["migrant_births"] = f"""{DISAGG}
SELECT region, draw, CAST(t AS INTEGER) AS t, round(b, 6) + 0.0e0 AS births
FROM (SELECT region, draw, generate_subscripts(births, 1) AS t, unnest(births) AS b FROM dn)"""

O["project_native"] = f"""{DISAGG}
{long2('dn', 'native', value='pop')}"""

O["totals"] = f"""{DISAGG},
tt AS (SELECT region, draw, list_transform(native, lambda pop, i: {{'native': {_sum('pop')},
         'migrant': list_reduce(cohorts, lambda acc, c: acc + {_sum('c[i]')}, 0.0e0)}}) AS tv FROM dn)
SELECT region, draw, CAST(t AS INTEGER) AS t, round(v.native, 6) + 0.0e0 AS native, round(v.migrant, 6) + 0.0e0 AS migrant,
       round(v.native + v.migrant, 6) + 0.0e0 AS total
FROM (SELECT region, draw, generate_subscripts(tv, 1) AS t, unnest(tv) AS v FROM tt)"""


# ------------------------------------------------------------ slice 8: scoring and overlay

import math  # noqa: E402

from ..functions.scalar import _dlit  # noqa: E402

_LS2P = _dlit(0.5 * math.log(2 * math.pi))
_LN2 = _dlit(math.log(2.0))


def _ln(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def _normal(x: str, mu: str, sd: str) -> str:
    z = f"(({x}) - ({mu})) / ({sd})"
    return f"(-{_LS2P} - {_ln(sd)} - 0.5e0 * {z} * {z})"


def _lognormal(x: str, mu: str, sd: str) -> str:
    return f"({_normal(_ln(x), mu, sd)} - {_ln(x)})"


O["composition"] = O["count_cohort_age"].replace(
    "SELECT grid.mig_year, grid.age, CAST(coalesce(c.n, 0) AS BIGINT) AS n\nFROM grid LEFT JOIN c ON c.mig_year = grid.mig_year AND c.age = grid.age",
    """, gr AS (SELECT grid.mig_year, grid.age, CAST(coalesce(c.n, 0) AS DOUBLE) AS n
           FROM grid LEFT JOIN c ON c.mig_year = grid.mig_year AND c.age = grid.age),
w AS (SELECT *, sum(n) OVER (PARTITION BY mig_year) AS total,
             row_number() OVER (PARTITION BY mig_year ORDER BY age) AS pos FROM gr),
s2 AS (SELECT *, CASE WHEN total <> 0 THEN n / total END AS share FROM w),
r AS (SELECT *, max(CASE WHEN pos = 10 THEN share END) OVER (PARTITION BY mig_year) AS ref FROM s2)
SELECT mig_year, age, round(n, 6) + 0.0e0 AS n, round(total, 6) + 0.0e0 AS total, round(share, 6) + 0.0e0 AS share,
       round(CASE WHEN ref <> 0 THEN """ + _ln("share / ref") + """ END, 6) + 0.0e0 AS log_ratio FROM r""")

def _total(v: str) -> str:
    return _sum(v)


def _ratios(v: str) -> str:
    return f"list_transform({v}, lambda x: {_ln(f'(x / {_total(v)}) / ({v}[10] / {_total(v)})')})"


def _hh(top: int) -> str:
    """Household counts per age group, the open bin starting ``top`` years early."""
    return f"""
hdom AS (SELECT CAST(unnest(range(0, (SELECT max(age) FROM surv) + 1, 5)) AS INTEGER) AS age),
hb AS (SELECT age AS lo, lead(age) OVER (ORDER BY age) AS hi
       FROM (SELECT CAST(unnest(range(0, (SELECT max(age) FROM surv) - {top} + 1, 5)) AS INTEGER) AS age)),
hh AS (SELECT TRY_CAST(age AS DOUBLE) AS x FROM v_household WHERE gender = 2 AND age IS NOT NULL),
hc AS (SELECT hb.lo AS age, count(*) AS n FROM hh LEFT JOIN hb ON hh.x >= hb.lo AND (hb.hi IS NULL OR hh.x < hb.hi)
       GROUP BY hb.lo),
hg AS (SELECT coalesce(hc.age, hdom.age) AS age, CAST(coalesce(hc.n, 0) AS DOUBLE) AS n
       FROM hc FULL JOIN hdom ON hc.age = hdom.age),
hv AS (SELECT list(n ORDER BY age) AS obs_hh FROM hg)"""


_DRAWS_OBS = DRAWS.replace(duck_cte('v_life', 'v_fert_wide', 'v_pop_wide', 'v_pop_wide_proj', 'v_rows'),
                           duck_cte('v_life', 'v_fert_wide', 'v_pop_wide', 'v_pop_wide_proj', 'v_rows',
                                    'v_person', 'v_household'))
_HH_FLOOR = "list_transform(obs_hh, lambda v: greatest(v, 1.0e-3))"
_TOBS = ("CASE WHEN CAST(regexp_extract(region, '([0-9]+)$', 1) AS INTEGER) % 10 = 0 THEN [0] "
         "WHEN CAST(regexp_extract(region, '([0-9]+)$', 1) AS INTEGER) % 10 = 5 THEN [12, 14] ELSE [14] END")
_UNI_POP0 = "list_transform(log_pop_0_ratios_raw, lambda r: exp(4.605170185988092e0 + 0.3e0 * r))"


def score_ctes(pop0: str, rates: str, top: int) -> str:
    """pp: draws with the observations, the observed periods and the projection (rates: index of the step's period)."""
    return f"""{_DRAWS_OBS},
{_hh(top).strip()},
pp AS (SELECT region, draw, sigma_pop, hv.obs_hh, {_TOBS} AS t_obs,
              {_fold(pop0, 'len(surv)', _step('acc[-1]', f'surv[{rates}]', f'reprod[{rates}]'))} AS pop
       FROM pd, hv)"""


def _over(term: str) -> str:
    return (f"CASE WHEN t_obs[1] > 0 THEN list_reduce(list_transform(t_obs, lambda tt: {term}), "
            f"lambda x, y: x + y, 0.0e0) ELSE 0.0e0 END")


_NORMAL_LL = _over(_sum("list_transform(list_zip(obs_hh, pop[tt]), lambda z: " + _normal('z[1]', 'z[2]', 'sigma_pop') + ")"))
_RATIO_LL = _over(_lognormal(_total(_HH_FLOOR), _ln(_total('pop[tt]')), 'sigma_pop') + " + "
                  + _sum("list_transform(list_zip(" + _ratios(_HH_FLOOR) + ", " + _ratios('pop[tt]') + "), lambda z: "
                         + _normal('z[1]', 'z[2]', '1.0e0') + ")"))

for _name, _p0, _rates, _top, _ll in (
        ("score_lognormal_init", _LN_POP0, "t - 1", 0, _NORMAL_LL), ("score_lognormal_obs", _LN_POP0, "t", 0, _RATIO_LL),
        ("score_uniform_init", _UNI_POP0, "t", 5, _NORMAL_LL), ("score_dirichlet_init", _DIR_POP0, "t", 5, _NORMAL_LL)):
    O[_name] = f"""{score_ctes(_p0, _rates, _top)}
SELECT region, draw, CAST(len(t_obs) AS INTEGER) AS n_obs, round({_ll}, 6) + 0.0e0 AS obs_ll FROM pp"""

O["score_observations"] = f"""
SELECT a.region, a.draw, a.n_obs, a.obs_ll AS normal_ll, b.obs_ll AS lognormal_ll
FROM ({O['score_lognormal_init']}) a JOIN ({O['score_lognormal_obs']}) b ON a.region = b.region AND a.draw = b.draw"""


def _density() -> str:
    never = "'-inf'::DOUBLE"
    return f"""CASE family
         WHEN 'normal' THEN {_normal('value', 'p1', 'p2')}
         WHEN 'half_normal' THEN CASE WHEN value < 0 THEN {never} ELSE {_LN2} + {_normal('value', '0.0e0', 'p2')} END
         WHEN 'lognormal' THEN CASE WHEN value <= 0 THEN {never} ELSE {_lognormal('value', 'p1', 'p2')} END
         WHEN 'gamma' THEN CASE WHEN value <= 0 THEN {never} ELSE
              p1 * {_ln('p2')} + (p1 - 1) * {_ln('value')} - p2 * value - lgamma(p1) END END"""


def priors_ctes(view: str, rows) -> str:
    """j: every draw with its prior, a full variable name going before a parameter name."""
    values = ", ".join(f"('{p}', '{f}', {_dlit(a)}, {_dlit(b)})" for p, f, a, b in rows)
    return f"""spec AS (SELECT * FROM (VALUES {values}) t(param, family, p1, p2)),
j AS (SELECT d.*, regexp_extract(d.variable, '^([^\\[]+)', 1) AS param, coalesce(o.family, n.family) AS family,
             coalesce(o.p1, n.p1) AS p1, coalesce(o.p2, n.p2) AS p2
      FROM {view} d LEFT JOIN spec o ON d.variable = o.param
      LEFT JOIN spec n ON regexp_extract(d.variable, '^([^\\[]+)', 1) = n.param)"""


# The prior tables of the registered queries.
_PRIORS = [("fert", "normal", 0.0, 1.0), ("fert_sub", "half_normal", 0.0, 0.05),
           ("pop_mig_true", "lognormal", math.log(100), 0.3), ("total_pop", "gamma", 2.0, 0.002)]
_RAW = [("logit_surv_raw", "normal", 0.0, 1.0), ("log_fert_sub_raw", "normal", 0.0, 1.0)]
_MODEL_PRIORS = {
    "disaggregated": _RAW + [("sigma_fert", "half_normal", 0.0, 0.05), ("sigma_surv", "half_normal", 0.0, 0.07),
                             ("log_pop_mig_init_total", "normal", 4.0, 1.0), ("log_pop_mig_init_ratios", "normal", 0.0, 1.0)],
    "dirichlet_init": _RAW + [("sigma_pop", "half_normal", 0.0, 10.0), ("sigma_fert", "half_normal", 0.0, 1.0),
                              ("sigma_surv", "half_normal", 0.0, 1.0), ("log_pop_0_total_true_raw", "normal", 0.0, 1.0)],
    "lognormal_init": _RAW + [("sigma_pop", "half_normal", 0.0, 10.0), ("sigma_fert", "half_normal", 0.0, 10.0),
                              ("sigma_surv", "half_normal", 0.0, 10.0), ("log_pop_0_total_true_raw", "normal", 0.0, 1.0),
                              ("log_pop_0_ratios_raw", "normal", 0.0, 1.0)],
    "lognormal_obs": _RAW + [("sigma_pop", "half_normal", 0.0, 1.0), ("sigma_fert", "half_normal", 0.0, 10.0),
                             ("sigma_surv", "half_normal", 0.0, 10.0), ("log_pop_0_total_true_raw", "normal", 0.0, 1.0),
                             ("log_pop_0_ratios_raw", "normal", 0.0, 1.0)],
    "uniform_init": _RAW + [("sigma_pop", "half_normal", 0.0, 10.0), ("sigma_fert", "half_normal", 0.0, 10.0),
                            ("sigma_surv", "half_normal", 0.0, 10.0), ("pop_0_true", "lognormal", math.log(100), 0.3)]}
_EVERY_PRIOR = sorted({r[0]: r for rows in _MODEL_PRIORS.values() for r in rows}.values())
_ALL_DRAWS = "d0 AS (SELECT * FROM v_draws1 UNION ALL SELECT * FROM v_draws2 UNION ALL SELECT * FROM v_draws3)"
_LOG_PRIOR = f"""SELECT run_id, chain, iteration, round(sum({_density()}), 6) + 0.0e0 AS log_prior, count(*) AS n_terms
FROM j WHERE family IS NOT NULL GROUP BY run_id, chain, iteration"""
_NO_PRIOR = "SELECT param, count(*) AS n_values FROM j WHERE family IS NULL GROUP BY param"

O["score_priors"] = f"""
{duck_cte('v_draws1', 'v_draws2', 'v_draws3')}, {_ALL_DRAWS}, {priors_ctes('d0', _PRIORS)}
{_LOG_PRIOR}"""

O["score_model_priors"] = "\nUNION ALL\n".join(f"""SELECT '{_m}' AS model, * FROM (
{duck_cte('v_params')}, {priors_ctes('v_params', _rows)}
{_LOG_PRIOR})""" for _m, _rows in _MODEL_PRIORS.items())

_GAMMA = """CASE WHEN z[1] <= 0 THEN '-inf'::DOUBLE ELSE
  (500 * z[2] - 1) * ln(z[1]) - z[1] - lgamma(500 * z[2]) END"""
O["score_dirichlet_prior"] = f"""{DRAWS}
SELECT region, draw, round({_sum(f"list_transform(list_zip(gamma_dirichlet, profile), lambda z: {_GAMMA})")}, 6) + 0.0e0 AS log_prior
FROM pb"""

O["unmatched_parameters"] = f"""
SELECT * FROM ({duck_cte('v_draws1', 'v_draws2', 'v_draws3')}, {_ALL_DRAWS}, {priors_ctes('d0', _PRIORS)} {_NO_PRIOR})
UNION ALL SELECT * FROM ({duck_cte('v_params')}, {priors_ctes('v_params', _EVERY_PRIOR)} {_NO_PRIOR})"""

def _grid(name: str, value: str) -> str:
    """Rows of a registered count query as a subquery."""
    return f"(SELECT {value} FROM ({O[name]}))"


O["model_record"] = f"""
{duck_cte('v_life', 'v_pop_wide', 'v_pop_wide_proj')}, {SURV}, {SHARES}, {SHARES_U},
regions AS (SELECT DISTINCT region FROM surv),
obs AS (
  SELECT 'pop_mig_obs' AS field, dense_rank() OVER (ORDER BY mig_year) AS t, dense_rank() OVER (ORDER BY age) AS a,
         CAST(n AS DOUBLE) AS value FROM {_grid('count_cohort_age', 'mig_year, age, n')}
  UNION ALL SELECT 'pop_native_obs', 1, dense_rank() OVER (ORDER BY age), n FROM {_grid('count_native_age', 'age, n')}
  UNION ALL SELECT 'pop_obs', 1, dense_rank() OVER (ORDER BY age), n FROM {_grid('count_full_outer', 'age, n')}
  UNION ALL SELECT * FROM (VALUES ('t_obs', 1, 1, 15.0), ('n_obs', 1, 1, 1.0), ('fert_hyper', 1, 1, 0.05),
    ('surv_hyper', 1, 1, 0.07), ('sd_init_ratios', 1, 1, 5.0), ('dirichlet_factor', 1, 1, 500.0)) c),
f AS (SELECT *, min(year) OVER (PARTITION BY region) AS y0, max(age) OVER (PARTITION BY region) AS amax FROM shares)
SELECT region, field, 1 AS i, CAST(t AS INTEGER) AS t, CAST(a AS INTEGER) AS a, {r6('value', 'value')} FROM (
  SELECT region, field, t, a, value FROM regions, obs
  UNION ALL SELECT s.region, 'init_mig_pop_props_data', dense_rank() OVER (PARTITION BY s.region ORDER BY s.year),
         dense_rank() OVER (PARTITION BY s.region ORDER BY s.age), u.pop_prop
  FROM surv s LEFT JOIN ushares u ON u.region = s.region AND u.year = s.year AND u.age = s.age
  UNION ALL SELECT region, 'pop_0_prop_data', 1, row_number() OVER (PARTITION BY region ORDER BY age), pop_prop
  FROM f WHERE year = y0 AND age <> amax)"""

_FERT_SUMM = f"""
{duck_cte('v_life', 'v_draws2', 'v_fert_wide')}, {SURV}, {summ('v_draws2')},
ex AS (SELECT *, {idx(1)} AS i1, {idx(2)} AS i2 FROM summ WHERE regexp_matches(variable, '^fert\\[')),
ex2 AS (SELECT run_id, CAST(coalesce(y.value, i1) AS INTEGER) AS year, CAST(coalesce(a.value, i2) AS INTEGER) AS age,
               q5, q50, q95
        FROM ex LEFT JOIN ydim y ON y.number = i1 LEFT JOIN adim a ON a.number = i2)"""

O["ribbon"] = f"""{_FERT_SUMM}
SELECT run_id, year, age, {qcols()} FROM ex2"""

O["overlay_rates"] = f"""{_FERT_SUMM}, fert AS ({FERT})
SELECT f.region, e.year, e.age, {qcols(prefix='e.')}, round(f.fert, 6) + 0.0e0 AS input_rate,
       round(f.fert - e.q50, 6) + 0.0e0 AS diff_q50, (f.fert >= e.q5 AND f.fert <= e.q95) AS inside_90
FROM ex2 e LEFT JOIN fert f ON f.year = e.year AND f.age = e.age"""


# ------------------------------------------------------------ slice 9: run store
O["run_store_roundtrip"] = O["scenario_report"]

O["sources_roundtrip"] = f"""
{duck_cte('v_pop_wide', 'v_household', 'v_list', 'v_draws2')},
p AS ({tidy_sql('v_pop_wide', POP_BANDS, 'pop', False)})
SELECT 'wide' AS source, count(*) AS n, round(sum(pop), 3) AS total FROM p
UNION ALL SELECT 'survey', count(*), round(sum(TRY_CAST(age AS DOUBLE)), 3) FROM v_household
UNION ALL SELECT 'lookup', count(*), round(CAST(sum(length(tribe_name)) AS DOUBLE), 3) FROM v_list
UNION ALL SELECT 'draws', count(*), round(sum(value), 3) FROM v_draws2 WHERE variable LIKE 'fert[%'"""


O["preamble_rates"] = f"""
{duck_cte('v_pop_wide')}, p AS ({tidy_sql('v_pop_wide', POP_BANDS, 'pop', False)})
SELECT * REPLACE (round(pop, 6) + 0.0e0 AS pop) FROM p"""

O["sampler_roundtrip"] = f"""
{duck_cte('v_draws2')}
SELECT run_id, regexp_extract(variable, '^([^\\[]+)', 1) AS base, {idx(1)} AS t, {idx(2)} AS a, count(*) AS n,
       {r6('sum(value)', 'total')}, {r6('sum(value * chain)', 'by_chain')}
FROM v_draws2 GROUP BY run_id, variable"""

O["extract_dictionary"] = O["extract_indexed_2"]


# ------------------------------------------------------------ additions: uniform initial, cohort scores

O["project_uniform"] = f"""{DRAWS},
pp AS (SELECT region, draw, {_fold(_UNI_POP0, 'len(surv)', _step('acc[-1]', 'surv[t]', 'reprod[t]'))} AS pop
       FROM pd)
{long2('pp', 'pop', value='pop')}"""

_DISAGG_OBS = DISAGG.replace(duck_cte('v_life', 'v_fert_wide', 'v_pop_wide', 'v_pop_wide_proj', 'v_rows'),
                             duck_cte('v_life', 'v_fert_wide', 'v_pop_wide', 'v_pop_wide_proj', 'v_rows', 'v_person')) \
    .replace(f"SELECT *, {_TOT} AS tot", f"SELECT *, {_TOT_OBS} AS tot").replace("FROM pd),\ndc AS", f"FROM (SELECT *, {_TOBS_MIG} AS t_obs FROM pd)),\ndc AS")
_NORM1 = _normal("z[1]", "z[2]", "1.0e0")

O["score_disaggregated"] = f"""{_DISAGG_OBS}, {BINS},
mp0 AS (SELECT * FROM v_person WHERE basic_gender = 2
        AND year_migration_m IS NOT NULL AND age_migration_m IS NOT NULL),
mb AS (SELECT CAST(pbx.lo AS INTEGER) AS mig_year, CAST(abx.lo AS INTEGER) AS age FROM mp0
       LEFT JOIN pbins pbx ON {in_bin('mp0.year_migration_m', 'pbx')}
       LEFT JOIN abins abx ON {in_bin('mp0.basic_age', 'abx')}),
mc AS (SELECT mig_year, age, count(*) AS n FROM mb WHERE mig_year IS NOT NULL AND age IS NOT NULL
       GROUP BY mig_year, age),
mg AS (SELECT CAST(y.value AS INTEGER) AS mig_year, CAST(a.age AS INTEGER) AS age,
              CAST(coalesce(mc.n, 0) AS DOUBLE) AS n
       FROM ydim y CROSS JOIN ages a LEFT JOIN mc ON mc.mig_year = y.value AND mc.age = a.age),
mm AS (SELECT list(r ORDER BY mig_year) AS mig_obs
       FROM (SELECT mig_year, list(n ORDER BY age) AS r FROM mg GROUP BY mig_year)),
np0 AS (SELECT * FROM v_person WHERE basic_gender = 2 AND born_kenya_m = 1),
nb AS (SELECT CAST(abx.lo AS INTEGER) AS age FROM np0 LEFT JOIN abins abx ON {in_bin('np0.basic_age', 'abx')}),
nc AS (SELECT age, count(*) AS n FROM nb WHERE age IS NOT NULL GROUP BY age),
nv AS (SELECT list(CAST(coalesce(nc.n, 0) AS DOUBLE) ORDER BY a.age) AS nat_obs
       FROM ages a LEFT JOIN nc ON nc.age = a.age)
SELECT region, draw, CAST(len(t_obs) AS INTEGER) AS n_obs, round({_over(f"""
         list_reduce(list_transform(list_zip(mig_obs, cohorts), lambda zz:
             {_sum("list_transform(list_zip(zz[1], zz[2][tt]), lambda z: " + _NORM1 + ")")}),
           lambda x, y: x + y, 0.0e0)
         + {_sum("list_transform(list_zip(nat_obs, native[tt]), lambda z: " + _NORM1 + ")")}""")}, 2) + 0.0e0 AS obs_ll
FROM dn, mm, nv"""


O["summarise_full"] = f"""{ESS},
pc AS (SELECT run_id, variable, sc, count(*) AS n, avg(z) AS mz, var_samp(z) AS vz,
              avg(zf) AS mf, var_samp(zf) AS vf, bool_or(is_const) AS cst
       FROM zz GROUP BY run_id, variable, sc),
rh AS (SELECT run_id, variable,
              sqrt((max(n) * var_samp(mz) / avg(vz) + max(n) - 1) / max(n)) AS rb,
              sqrt((max(n) * var_samp(mf) / avg(vf) + max(n) - 1) / max(n)) AS rf,
              bool_or(cst) AS cst
       FROM pc GROUP BY run_id, variable),
{summ('v_draws1', DEFAULT_PROBS)}
SELECT s.run_id, s.variable, {r6('s.mean', 'mean')}, {r6('s.sd', 'sd')},
       {", ".join(r6('s.' + quantile_name(p), quantile_name(p)) for p in DEFAULT_PROBS)},
       round(CASE WHEN rh.cst THEN NULL ELSE greatest(rh.rb, rh.rf) END, 6) + 0.0e0 AS rhat,
       round(CASE WHEN fl.cst THEN NULL ELSE w.eb END, 6) + 0.0e0 AS ess_bulk,
       round(CASE WHEN fl.cst OR w.el IS NULL OR w.eh IS NULL THEN NULL ELSE least(w.el, w.eh) END, 6) + 0.0e0 AS ess_tail
FROM summ s LEFT JOIN rh USING (run_id, variable) LEFT JOIN wide w USING (run_id, variable)
     LEFT JOIN fl USING (run_id, variable)"""

O["summarise_bucketed"] = O["summarise_full"]
