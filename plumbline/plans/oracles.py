"""SQL statements that state independently what the catalogue's queries return.

Plain ANSI-style SQL over the given tables, written for a single-node engine and
for checking only: wide tables are spelled out as unions and windows.
"""

from __future__ import annotations

from itertools import combinations

FEATURES = [f"V{i}" for i in range(1, 25)] + ["Amount"]
WEIGHTS = [1.2 if j == 2 else 1.5 if j == 13 else (-1) ** j * 0.02 * j for j in range(1, 26)]

TX = """tx AS (
SELECT o.o_orderkey AS id,
 l.V1,l.V2,l.V3,l.V4,l.V5,l.V6,l.V7,l.V8,l.V9,l.V10,l.V11,l.V12,l.V13,l.V14,l.V15,l.V16,l.V17,
 l.V18,l.V19,l.V20,l.V21,
 c.c_acctbal AS V22, CAST(month(o.o_orderdate) AS double) AS V23,
 CAST(substr(o.o_orderpriority,1,1) AS double) AS V24, o.o_totalprice AS Amount,
 CASE WHEN l.V13 >= 0.09 AND l.V2 > 120 THEN 1 ELSE 0 END AS Class
FROM orders o JOIN (
 SELECT l_orderkey, CAST(count(*) AS double) V1,
  sum(l_quantity) V2, avg(l_quantity) V3, min(l_quantity) V4, max(l_quantity) V5,
  sum(l_extendedprice) V6, avg(l_extendedprice) V7, min(l_extendedprice) V8, max(l_extendedprice) V9,
  sum(l_discount) V10, avg(l_discount) V11, min(l_discount) V12, max(l_discount) V13,
  sum(l_tax) V14, avg(l_tax) V15, min(l_tax) V16, max(l_tax) V17,
  CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS double) V18,
  CAST(sum(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS double) V19,
  CAST(sum(CASE WHEN l_returnflag='N' THEN 1 ELSE 0 END) AS double) V20,
  CAST(sum(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS double) V21
 FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey=o.o_orderkey
JOIN customer c ON c.c_custkey=o.o_custkey)"""


def _dirty() -> str:
    special = {
        "V5": "CASE WHEN id % 17 = 0 THEN NULL ELSE V5 END AS V5",
        "V7": "CASE WHEN id % 19 = 0 THEN 'NaN'::DOUBLE ELSE V7 END AS V7",
    }
    columns = ", ".join(special.get(f, f) for f in FEATURES)
    return f"""once AS (SELECT id, {columns}, Class, 1.0::DOUBLE AS K,
 CAST(CAST(V1 AS INTEGER) AS VARCHAR) AS T, o_orderpriority AS U, o_orderdate AS D,
 CASE WHEN id % 29 = 0 THEN NULL ELSE o_orderstatus END AS S
 FROM tx JOIN orders ON o_orderkey = id),
dirty AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE id % 23 = 0)"""


DIRTY = TX + ",\n" + _dirty()
DIRTY_TYPES = (
    [("id", "bigint")]
    + [(f, "double") for f in FEATURES]
    + [("Class", "int"), ("K", "double"), ("T", "string"), ("U", "string"), ("D", "timestamp_ntz"), ("S", "string")]
)
DIRTY_NUMERIC = [c for c, t in DIRTY_TYPES if t in ("bigint", "double", "int")]
COMPLETE = " AND ".join(
    f"{c} IS NOT NULL" + (f" AND NOT isnan({c})" if t == "double" else "") for c, t in DIRTY_TYPES
)


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


def rounded_columns(columns, digits: int = 6) -> str:
    return ", ".join(r(c, c, digits) for c in columns)


def long_of(source: str, columns, keep: str, name: str = "feature") -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keep}'{c}' AS \"{name}\", {i} AS feature_pos, CAST({c} AS DOUBLE) AS value FROM {source}"
        for i, c in enumerate(columns, 1)
    )


LONG = f"long AS ({long_of('tx', FEATURES, 'id, Class, ')})"
STATS = """st AS (SELECT feature, feature_pos, avg(value) AS mean, median(value) AS median,
 stddev_samp(value) AS std FROM long GROUP BY feature, feature_pos)"""
W = "w(feature_pos, w) AS (VALUES " + ", ".join(f"({j}, '{w!r}'::DOUBLE)" for j, w in enumerate(WEIGHTS, 1)) + ")"
PHI = """phi AS (SELECT id, Class, long.feature, long.feature_pos, value, mean, median, std, w,
 w * (value - mean) / std AS phi FROM long JOIN st USING (feature_pos) JOIN w USING (feature_pos))"""
SCORED = """raw AS (SELECT id, Class, -2.0::DOUBLE + sum(phi) AS margin FROM phi GROUP BY id, Class),
scored AS (SELECT id, Class, margin, 1.0 / (1.0 + exp(-margin)) AS p,
 CASE WHEN 1.0 / (1.0 + exp(-margin)) > 0.5 THEN 1 ELSE 0 END AS prediction FROM raw)"""
LINEAR = ",\n".join([TX, LONG, STATS, W, PHI, SCORED])


def ranked(source: str, partition: str, value: str = "phi") -> str:
    return (
        f"SELECT *, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY "
        f"floor(abs({value}) / top * 1099511627776.0 + 0.5) DESC, feature_pos) AS INTEGER) AS rank "
        f"FROM (SELECT *, max(abs({value})) OVER (PARTITION BY {partition}) AS top FROM {source})"
    )


RANKED = f"ranked AS ({ranked('phi', 'id')})"
SIG = "1.0 / (1.0 + exp(-({})))"
IMPACTS = f"""impacts AS (SELECT id, rank, feature_pos, abs(phi) AS importance,
 abs(p - {SIG.format('margin - phi')}) AS impact FROM ranked JOIN scored USING (id))"""


def row_fidelity(impacts: str = "impacts") -> str:
    return f"""fid AS (SELECT id,
 coalesce(sum((impact + previous) / 2), 0.0) AS aufc,
 CASE WHEN max(importance) = 0 OR max(impact) = 0 THEN 0.0
  ELSE covar_samp(importance, impact) / nullif(stddev_samp(importance) * stddev_samp(impact), 0) END AS correlation
 FROM (SELECT *, lag(impact) OVER (PARTITION BY id ORDER BY rank) AS previous FROM {impacts}) GROUP BY id)"""


MEDIAN_SHIFT = "(phi - w * (median - mean) / std)"
CURVE = f"""curve AS (SELECT id, rank AS k, power(p - {SIG.format('margin - moved')}, 2) AS loss
 FROM (SELECT *, sum({MEDIAN_SHIFT}) OVER (PARTITION BY id ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moved FROM ranked) JOIN scored USING (id))"""


def uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT + 0.5) / 4294967296.0)"


def hash_key(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::UBIGINT)::BIGINT"


def _mix(h: str, out: str) -> str:
    return (
        f"((xor({h}, {h} >> 15)) * 739982445) & 2147483647 AS {out}1, "
        f"((xor({out}1, {out}1 >> 12)) * 695872825) & 2147483647 AS {out}2, "
        f"xor({out}2, {out}2 >> 15) AS {out}3"
    )


NOISE_WORDS = """words AS (SELECT id, rep,
 (('0x' || substr(md5(concat_ws('|', 42, id, rep, 'noise')), 1, 8))::UBIGINT & 2147483647)::BIGINT AS a,
 (('0x' || substr(md5(concat_ws('|', 42, id, rep, 'noise')), 9, 8))::UBIGINT & 2147483647)::BIGINT AS b
 FROM tx, (SELECT CAST(range AS INTEGER) AS rep FROM range(1, 6)))"""
NOISE = f"""{NOISE_WORDS},
draws AS (SELECT id, rep, step, (y3 + 0.5) / 2147483648.0 AS u FROM (
 SELECT id, rep, step, (a + step * 1226874159) & 2147483647 AS h, {_mix('h', 'x')},
  xor(x3, b) AS g, {_mix('g', 'y')}
 FROM words, (SELECT range AS step FROM range(1, 51)))),
noise AS (SELECT id, rep, CAST((step + 1) // 2 AS INTEGER) AS feature_pos,
 sqrt(-2.0 * ln(max(CASE WHEN step % 2 = 1 THEN u END))) * cos(2 * pi() * max(CASE WHEN step % 2 = 0 THEN u END)) AS g,
 max(CASE WHEN step % 2 = 1 THEN u END) AS u
 FROM draws GROUP BY id, rep, (step + 1) // 2)"""
# The uniform strategy takes draw number j of a row, not a pair of draws.
FLAT = "flat AS (SELECT id, rep, CAST(step AS INTEGER) AS feature_pos, u FROM draws WHERE step <= 25)"
PAIRS = f"""{NOISE},
pairs AS (SELECT id, rep, feature_pos, phi AS phi_original, phi + w * 0.01 * g AS phi_copy
 FROM noise JOIN phi USING (id, feature_pos))"""
SIMILAR = f"""ra AS ({ranked('pairs', 'id, rep', 'phi_original')}),
rb AS ({ranked('pairs', 'id, rep', 'phi_copy')}),
similar_pairs AS (SELECT id, rep,
 sum(ra.phi_original * ra.phi_copy) / (sqrt(sum(ra.phi_original * ra.phi_original)) * sqrt(sum(ra.phi_copy * ra.phi_copy))) AS cosine,
 {', '.join(f"count(*) FILTER (ra.rank <= {k} AND rb.rank <= {k})::DOUBLE / count(*) FILTER (ra.rank <= {k} OR rb.rank <= {k}) AS jaccard_{k}" for k in (5, 10, 20))}
 FROM ra JOIN rb USING (id, rep, feature_pos) GROUP BY id, rep)"""
STABLE = """stab AS (SELECT id, avg(cosine) AS cosine, avg(jaccard_5) AS jaccard_5,
 avg(jaccard_10) AS jaccard_10, avg(jaccard_20) AS jaccard_20 FROM similar_pairs GROUP BY id)"""

SCORE_CURVE = """sc AS (SELECT round(p, 6) AS score, count(*) FILTER (Class = 1) AS pos,
 count(*) FILTER (Class <> 1) AS neg FROM scored GROUP BY round(p, 6)),
points AS (SELECT score, pos, neg,
 CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
 CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM sc),
steps AS (SELECT *, tp::DOUBLE / (tp + fp) AS prec,
 coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS tp0,
 coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS fp0,
 lag(tp::DOUBLE / (tp + fp)) OVER (ORDER BY score DESC) AS prec0 FROM points),
areas AS (SELECT sum((fp - fp0) * (tp + tp0) / 2.0) / (max(tp) * max(fp)::DOUBLE) AS auc_roc,
 sum((tp - tp0) * (prec + coalesce(prec0, prec)) / 2.0) / max(tp) AS auc_pr,
 sum((tp - tp0) * prec) / max(tp) AS average_precision FROM steps)"""
CONFUSION = """cf AS (SELECT count(*) FILTER (Class = 0 AND prediction = 0)::DOUBLE AS tn,
 count(*) FILTER (Class = 0 AND prediction = 1)::DOUBLE AS fp,
 count(*) FILTER (Class = 1 AND prediction = 0)::DOUBLE AS fn,
 count(*) FILTER (Class = 1 AND prediction = 1)::DOUBLE AS tp FROM scored),
cm AS (SELECT tn / (tn + fn) AS precision_0, tp / (tp + fp) AS precision_1, tn / (tn + fp) AS recall_0,
 tp / (tp + fn) AS recall_1, 2 * tn / (2 * tn + fp + fn) AS f1_0, 2 * tp / (2 * tp + fp + fn) AS f1_1,
 ((tn + fp) * 2 * tn / (2 * tn + fp + fn) + (tp + fn) * 2 * tp / (2 * tp + fp + fn)) / (tn + fp + fn + tp) AS f1_weighted,
 (tn + tp) / (tn + fp + fn + tp) AS accuracy FROM cf)"""


def _describe(source: str, columns, quartiles: bool) -> str:
    extra = (
        ", round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, "
        "round(quantile_cont(value, 0.75), 4) AS q75"
        if quartiles
        else ""
    )
    return (
        f'SELECT "column", count(*) AS n, {r("avg(value)", "mean", 4)}, {r("stddev_samp(value)", "stddev", 4)}, '
        f'{r("min(value)", "min", 4)}, {r("max(value)", "max", 4)}{extra} '
        f"FROM ({long_of(source, columns, '', 'column')}) WHERE value IS NOT NULL AND NOT isnan(value) "
        'GROUP BY "column"'
    )


def _correlations(source: str, columns, pairs) -> str:
    def clean(c):
        return f"CASE WHEN NOT isnan({c}) THEN {c} END"

    def corr(a, b):
        spread = (
            f"stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
            f"stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END)"
        )
        return f"covar_samp({a}, {b}) / nullif({spread}, 0)"

    numbers = ", ".join(f"{clean(c)} AS {c}" for c in columns)
    wide = ", ".join(f"{corr(a, b)} AS r{i}" for i, (a, b) in enumerate(pairs))
    return (
        f"nums AS (SELECT {numbers} FROM {source}), cw AS (SELECT {wide} FROM nums), cl AS ("
        + " UNION ALL ".join(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, r{i} AS r FROM cw" for i, (a, b) in enumerate(pairs)
        )
        + ")"
    )


BUCKET = "CAST(least(floor(round(round(coalesce((value - low) / nullif(high - low, 0), 0.0), 9) * {b}, 6)), {b} - 1) AS INTEGER)"
BOXES = """boxes AS (SELECT feature AS "column", Class, quantile_cont(value, 0.25) AS q25,
 quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM long GROUP BY feature, Class),
boxed AS (SELECT "column", long.Class, q25, q50, q75, value,
 value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside
 FROM long JOIN boxes ON long.feature = boxes."column" AND long.Class = boxes.Class)"""

# Leaves of the two fixed trees: value, then conditions with the share of cover kept by each.
_A, _B, _C = "V13 <= 0.085", "V2 <= 120", "V3 <= 25"
LEAVES = [
    (-1.0, [("V13", _A, 70 / 100)]),
    (-0.5, [("V13", f"NOT ({_A})", 30 / 100), ("V2", _B, 20 / 30)]),
    (1.0, [("V13", f"NOT ({_A})", 30 / 100), ("V2", f"NOT ({_B})", 10 / 30)]),
    (0.5 * -0.4, [("V2", _B, 75 / 100)]),
    (0.5 * 0.2, [("V2", f"NOT ({_B})", 25 / 100), ("V3", _C, 15 / 25)]),
    (0.5 * 0.6, [("V2", f"NOT ({_B})", 25 / 100), ("V3", f"NOT ({_C})", 10 / 25)]),
]


def _tree_phi(feature: str) -> str:
    terms = []
    for value, path in LEAVES:
        for i, (f, test, kept) in enumerate(path):
            if f != feature:
                continue
            own = f"({value!r} * (CAST({test} AS INTEGER) - {kept!r}))"
            if len(path) == 2:
                _, other, share = path[1 - i]
                own += f" * 0.5 * ({share!r} + CAST({other} AS INTEGER))"
            terms.append(own)
    return f"CAST({' + '.join(terms)} AS DOUBLE)"


TREE_MARGIN = (
    "CAST(CASE WHEN V13 <= 0.085 THEN -1.0 WHEN V2 <= 120 THEN -0.5 ELSE 1.0 END "
    "+ 0.5 * CASE WHEN V2 <= 120 THEN -0.4 WHEN V3 <= 25 THEN 0.2 ELSE 0.6 END AS DOUBLE)"
)


ORDERS = (
    "o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"
)


def _with(parts, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    tx_all = f"SELECT id, {rounded_columns(FEATURES)}, Class FROM tx"
    for name in ("csv_scan", "csv_scan_inferred", "repartitioned"):
        sql[name] = _with([TX], tx_all)
    sql["parquet_scan"] = (
        f"SELECT {ORDERS} FROM orders"
    )
    sql["persisted"] = f"SELECT {ORDERS}, count(*) OVER () AS n_rows FROM orders"
    sql["model_round_trip"] = _with([TX], "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM tx")
    none_off = "CAST(0 AS BIGINT) AS n_off"
    sql["model_nodes_check"] = f"SELECT {none_off}"
    sql["batch_score_check"] = _with([TX], f"SELECT count(*) AS n_rows, {none_off} FROM tx")
    sql["booster_evaluation_check"] = "SELECT 0 AS n_off"
    sql["booster_fit_check"] = f"SELECT CAST(100 AS BIGINT) AS n_trees, {none_off}"
    sql["early_stopping_check"] = "SELECT 100 AS n_fitted, 0 AS n_other_prefix, 0 AS n_off"
    in_fold = f"CAST(floor({uniform('42', 'id', chr(39) + 'fold' + chr(39))} * 3) AS INTEGER)"
    in_train = f"{uniform('42', 'id', chr(39) + 'split' + chr(39))} < 0.8"
    sql["cross_validation_check"] = _with(
        [TX], f"SELECT {in_fold} AS fold, count(*) AS n_rows, 8 AS n_settings, 0 AS n_off FROM tx WHERE {in_train} GROUP BY 1"
    )
    sql["logistic_check"] = f"SELECT CAST(0 AS BIGINT) AS n_sloping, {none_off}"
    sql["shallow_tree_check"] = f"SELECT CAST(0 AS BIGINT) AS n_outvoted, {none_off}"
    sql["coefficient_importance_check"] = f"SELECT {len(FEATURES)} AS n_features, 0 AS n_off"
    sql["explain_by_method_check"] = _with(
        [TX], f"SELECT method, count(*) AS n_rows, {none_off} FROM tx CROSS JOIN (VALUES ('shap'), ('lime')) m(method) GROUP BY method"
    )
    both_models = "(VALUES ('logistic_regression'), ('decision_tree')) m(model)"
    sql["train_on_explanations_check"] = f"SELECT {none_off}"
    sql["discriminative_power_check"] = f"SELECT model, {none_off} FROM {both_models}"
    sql["model_comparison_check"] = f"SELECT CAST(10 AS BIGINT) AS n_values, {none_off}"
    sql["raw_feature_baseline_check"] = (
        f"SELECT inputs, model, {none_off} FROM {both_models} CROSS JOIN (VALUES ('explanations'), ('features')) i(inputs)"
    )
    sql["boosted_fidelity_check"] = _with([TX], f"SELECT count(*) AS n_rows, {none_off} FROM tx")
    sql["boosted_curve_check"] = _with([TX], f"SELECT CAST({len(FEATURES)} * count(*) AS BIGINT) AS n_steps, {none_off} FROM tx")
    sql["training_report_check"] = f"SELECT {none_off}"
    sql["explanation_report_check"] = f"SELECT CAST(6 AS BIGINT) AS n_metrics, {none_off}"
    sql["approx_distinct_counts_check"] = f"SELECT CAST({len(DIRTY_TYPES)} AS BIGINT) AS n_columns, {none_off}"
    sql["boosted_importance_check"] = f"SELECT CAST({len(FEATURES)} AS BIGINT) AS n_features, {none_off}"
    sql["lime_check"] = _with([TX], f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_not_ten, {none_off} FROM tx")
    sql["tree_shap_additivity"] = _with([TX], "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_off FROM tx")
    sql["scored_output"] = _with([LINEAR], f"SELECT id, {r('p', 'p')}, p >= 0.8 AS flagged FROM scored")
    sql["statistics_output"] = _with([TX], _describe("tx", FEATURES, False))

    sql["feature_projection"] = _with([TX], f"SELECT {rounded_columns(FEATURES)} FROM tx")
    sql["column_drop"] = _with(
        [TX], f"SELECT id, {rounded_columns([f for f in FEATURES if f not in ('V1', 'V24')])} FROM tx"
    )
    sql["class_filter"] = _with([TX], tx_all + " WHERE Class = 1")
    day = "strftime(D, '%Y-%m-%d %H:%M:%S') AS D"
    shown = f"id, {rounded_columns([*FEATURES, 'K'])}, Class, T, U, {day}, S"
    sql["drop_missing_rows"] = _with([DIRTY], f"SELECT {shown} FROM dirty WHERE {COMPLETE}")
    sql["drop_duplicate_rows"] = _with([DIRTY], f"SELECT {shown} FROM (SELECT DISTINCT * FROM dirty)")
    sql["duplicate_report"] = _with(
        [DIRTY],
        "SELECT n_rows, n_distinct, n_rows - n_distinct AS n_removed FROM "
        "(SELECT (SELECT count(*) FROM dirty) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_distinct)",
    )
    sql["drop_constant_columns"] = _with(
        [DIRTY], f"SELECT id, {rounded_columns(FEATURES)}, Class, T, U, {day}, S FROM dirty"
    )
    text = "TRY_CAST({0} AS FLOAT)::DOUBLE AS {0}"
    casts = ", ".join(text.format(c) for c in ("T", "U", "S"))
    sql["cast_text_to_float"] = _with([DIRTY], f"SELECT id, {casts} FROM dirty")
    sql["clean_table"] = _with(
        [DIRTY],
        f"SELECT id, {rounded_columns(FEATURES)}, Class, {casts}, {day} "
        f"FROM (SELECT DISTINCT * FROM dirty WHERE {COMPLETE})",
    )
    sql["vector_assembly"] = _with([TX], f"SELECT id, {rounded_columns(FEATURES)} FROM tx")
    sql["prediction_label_pairs"] = _with(
        [LINEAR],
        "SELECT prediction::DOUBLE AS prediction, Class::DOUBLE AS label, count(*) AS n FROM scored GROUP BY prediction, Class",
    )

    def missing(c, t):
        return f"{c} IS NULL" + (f" OR isnan({c})" if t == "double" else "")

    sql["column_profile"] = _with(
        [DIRTY],
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {i} AS pos, '{t}' AS type, true AS nullable, count(*) FILTER ({missing(c, t)}) AS n_missing, "
            f"count(DISTINCT {c}) AS n_distinct FROM dirty"
            for i, (c, t) in enumerate(DIRTY_TYPES, 1)
        ),
    )
    sql["missing_counts"] = _with(
        [DIRTY],
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({missing(c, t)}) AS n_missing FROM dirty"
            for c, t in DIRTY_TYPES
        ),
    )
    sql["distinct_counts"] = _with(
        [DIRTY],
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM dirty" for c, _ in DIRTY_TYPES
        ),
    )
    sql["class_distribution"] = _with([TX], 'SELECT Class, count(*) AS "count" FROM tx GROUP BY Class')
    sql["describe_columns"] = _with([DIRTY], _describe("dirty", DIRTY_NUMERIC, False))
    sql["describe_with_quartiles"] = _with([DIRTY], _describe("dirty", DIRTY_NUMERIC, True))
    sql["value_distribution"] = _with(
        [
            DIRTY,
            "counted AS ("
            + " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS \"count\" FROM dirty GROUP BY {c}"
                for c, _ in DIRTY_TYPES
            )
            + ")",
        ],
        'SELECT "column", value, "count" FROM counted QUALIFY count(*) OVER (PARTITION BY "column") <= 20',
    )
    pairs = list(combinations(FEATURES, 2))
    sql["correlation_matrix"] = _with(
        [TX, _correlations("tx", FEATURES, pairs)],
        "SELECT col_a, col_b, round(r, 6) AS r FROM cl UNION ALL SELECT col_b, col_a, round(r, 6) FROM cl UNION ALL "
        + " UNION ALL ".join(f"SELECT '{f}', '{f}', 1.0::DOUBLE" for f in FEATURES),
    )
    with_constant = [*FEATURES, "K"]
    sql["pairwise_correlation"] = _with(
        [DIRTY, _correlations("dirty", with_constant, list(combinations(with_constant, 2)))],
        "SELECT col_a, col_b, round(r, 6) AS r FROM cl",
    )
    sql["strong_correlations"] = _with(
        [TX, _correlations("tx", FEATURES, pairs)],
        "SELECT col_a, col_b, round(r, 6) AS r FROM cl WHERE abs(r) >= 0.5",
    )
    limits = "limits AS (SELECT feature, min(value) AS low, max(value) AS high FROM long GROUP BY feature)"
    sql["histogram_by_class"] = _with(
        [TX, LONG, limits],
        f'SELECT feature AS "column", Class, {BUCKET.format(b=20)} AS bucket, count(*) AS n '
        "FROM long JOIN limits USING (feature) GROUP BY ALL",
    )
    sql["box_by_class"] = _with(
        [TX, LONG, BOXES],
        f'SELECT "column", Class, {rounded_columns(["q25", "q50", "q75"])}, '
        f"{r('min(value) FILTER (inside)', 'whisker_low')}, {r('max(value) FILTER (inside)', 'whisker_high')}, "
        'count(*) FILTER (NOT inside) AS n_outliers FROM boxed GROUP BY "column", Class, q25, q50, q75',
    )
    sql["outlier_counts"] = _with(
        [TX, LONG, BOXES],
        'SELECT "column", count(*) FILTER (NOT inside) AS n_outliers FROM boxed GROUP BY "column"',
    )
    sql["scatter_bins"] = _with(
        [
            TX,
            LONG,
            limits,
            f"bins AS (SELECT id, Class, feature, feature_pos, {BUCKET.format(b=10)} AS bin FROM long JOIN limits USING (feature))",
        ],
        "SELECT a.feature AS col_a, b.feature AS col_b, a.Class AS Class, a.bin AS bin_a, b.bin AS bin_b, count(*) AS n "
        "FROM bins a JOIN bins b ON a.id = b.id AND a.feature_pos < b.feature_pos GROUP BY ALL",
    )
    sql["feature_stats"] = _with(
        [TX, LONG, STATS], f"SELECT feature, feature_pos, {rounded_columns(['mean', 'median', 'std'], 4)} FROM st"
    )

    sql["join_explanations"] = _with([LINEAR], f"SELECT id, feature, {rounded_columns(['value', 'phi'])} FROM phi")
    wide = ", ".join(r(f"max(CASE WHEN feature = '{f}' THEN phi END)", f) for f in FEATURES)
    sql["join_labels"] = _with([LINEAR], f"SELECT id, Class, {wide} FROM phi GROUP BY id, Class")
    sql["explanation_matrix"] = _with([LINEAR], f"SELECT id, {wide} FROM phi GROUP BY id")
    sql["join_feature_stats"] = _with(
        [LINEAR], f"SELECT id, feature, {rounded_columns(['value', 'mean', 'median', 'std'])} FROM phi"
    )
    sql["align_explanations"] = _with(
        [LINEAR, PAIRS],
        f"SELECT id, rep, {r('sum(phi_original)', 'total_original')}, {r('sum(phi_copy)', 'total')}, "
        f"{r('max(abs(phi_copy - phi_original))', 'largest_change')} FROM pairs GROUP BY id, rep",
    )
    kinds = [("feature", i) for i in range(1, 26)] + [("k", i) for i in range(1, 26)] + [("rep", i) for i in range(1, 6)]
    sql["expand_instances"] = _with(
        [TX, "kinds(kind, i) AS (VALUES " + ", ".join(f"('{k}', {i})" for k, i in kinds) + ")"],
        "SELECT kind, i, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM tx, kinds GROUP BY kind, i",
    )

    sql["order_by_count"] = 'SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY o_orderpriority ORDER BY 2 DESC, 1'
    sql["global_importance"] = _with(
        [LINEAR],
        f"SELECT feature, feature_pos, {r('avg(abs(phi))', 'importance')} FROM phi GROUP BY feature, feature_pos ORDER BY 3 DESC",
    )
    sql["rank_features"] = _with([LINEAR, RANKED], f"SELECT id, rank, feature, {r('phi', 'phi')} FROM ranked")
    sql["top_k_features"] = _with(
        [LINEAR, RANKED],
        "SELECT id, string_agg(feature, ',' ORDER BY feature) AS top_features FROM ranked WHERE rank <= 5 GROUP BY id",
    )
    sql["first_rows"] = _with([TX], tx_all + " ORDER BY id LIMIT 100")

    sql["hash_split"] = _with(
        [TX],
        f"SELECT id, {rounded_columns(FEATURES)}, Class, CASE WHEN {uniform('42', 'id', chr(39) + 'split' + chr(39))} < 0.8 THEN 'train' ELSE 'test' END AS side FROM tx",
    )
    sql["validation_split"] = _with(
        [TX],
        "SELECT Class, is_train, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM "
        f"(SELECT *, {uniform('42', 'id', chr(39) + 'split' + chr(39))} < 0.7 AS is_train FROM tx) GROUP BY Class, is_train",
    )
    order = "row_number() OVER (PARTITION BY Class ORDER BY {}, id)"
    sql["balanced_sample"] = _with(
        [TX, f"o AS (SELECT *, {order.format(hash_key('42', 'id', chr(39) + 'balance' + chr(39)))} AS n FROM tx)"],
        f"SELECT id, {rounded_columns(FEATURES)}, Class FROM o WHERE n <= 50",
    )
    sql["union_classes"] = _with([TX], tx_all)
    sql["stratified_split"] = _with(
        [
            TX,
            f"o AS (SELECT *, {order.format(hash_key('42', 'id', chr(39) + 'strata' + chr(39)))} AS n, "
            "count(*) OVER (PARTITION BY Class) AS total FROM tx)",
        ],
        f"SELECT id, {rounded_columns(FEATURES)}, Class, n <= floor(0.8 * total + 1e-9) AS is_train FROM o",
    )
    sql["fold_split"] = _with(
        [TX],
        f"SELECT id, {rounded_columns(FEATURES)}, Class, CAST(floor({uniform('42', 'id', chr(39) + 'fold' + chr(39))} * 3) AS INTEGER) AS fold FROM tx",
    )

    sql["class_probabilities"] = _with(
        [LINEAR], f"SELECT id, {r('margin', 'margin')}, {r('1 - p', 'p0')}, {r('p', 'p1')}, prediction FROM scored"
    )
    for name, column in (
        ("area_under_roc", "auc_roc"),
        ("area_under_pr", "auc_pr"),
        ("average_precision", "average_precision"),
    ):
        sql[name] = _with([LINEAR, SCORE_CURVE], f"SELECT {r(column, column)} FROM areas")
    sql["score_curve"] = _with([LINEAR, SCORE_CURVE], "SELECT score, pos, neg, tp, fp FROM points")
    for name, columns in (
        ("f1_weighted", ["f1_0", "f1_1", "f1_weighted", "accuracy"]),
        ("precision_by_label", ["precision_0", "precision_1"]),
        ("recall_by_label", ["recall_0", "recall_1"]),
    ):
        sql[name] = _with([LINEAR, CONFUSION], f"SELECT {rounded_columns(columns)} FROM cm")
    sql["confusion_matrix"] = _with(
        [LINEAR],
        " UNION ALL ".join(
            f"SELECT {a} AS actual, {g} AS predicted, count(*) FILTER (Class = {a} AND prediction = {g}) AS n FROM scored"
            for a in (0, 1)
            for g in (0, 1)
        ),
    )
    sql["positive_class_metrics"] = _with(
        [LINEAR, CONFUSION, SCORE_CURVE],
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, {r(c, 'value')} FROM {t}"
            for m, c, t in (
                ("f1_score", "f1_1", "cm"),
                ("recall", "recall_1", "cm"),
                ("precision", "precision_1", "cm"),
                ("accuracy", "accuracy", "cm"),
                ("auc_pr", "average_precision", "areas"),
            )
        ),
    )
    sql["decision_threshold"] = _with([LINEAR], "SELECT id, p >= 0.8 AS flagged FROM scored")
    sql["balanced_weights"] = _with(
        [TX],
        f"SELECT id, Class, {r('count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY Class))', 'weight')} FROM tx",
    )

    sql["tree_shap_fixed"] = _with(
        [TX],
        "SELECT id, "
        + ", ".join(r(_tree_phi(f) if f in ("V2", "V3", "V13") else "0.0::DOUBLE", f"phi_{f}") for f in FEATURES)
        + " FROM tx",
    )
    sql["fixed_tree_scores"] = _with(
        [TX], f"SELECT id, {r(TREE_MARGIN, 'margin')}, {r(SIG.format(TREE_MARGIN), 'p')} FROM tx"
    )
    sql["linear_shap"] = _with([LINEAR], f"SELECT id, feature, feature_pos, {r('phi', 'phi')} FROM phi")
    sql["shap_summary"] = _with(
        [
            LINEAR,
            "top AS (SELECT feature FROM phi GROUP BY feature, feature_pos ORDER BY avg(abs(phi)) DESC, feature_pos LIMIT 20)",
            "cuts AS (SELECT feature, min(phi) AS low, max(phi) AS high, quantile_cont(value, 0.25) AS a, "
            "quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM phi GROUP BY feature)",
        ],
        "SELECT feature, CAST((value > a)::INTEGER + (value > b)::INTEGER + (value > c)::INTEGER AS INTEGER) AS value_bin, "
        f"{BUCKET.format(b=20).replace('value', 'phi')} AS phi_bin, count(*) AS n "
        "FROM phi JOIN cuts USING (feature) JOIN top USING (feature) GROUP BY ALL",
    )
    sql["surrogate_bins"] = _with(
        [
            TX,
            LONG,
            "cuts AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, "
            "quantile_cont(value, 0.75) AS c FROM long GROUP BY feature)",
            "placed AS (SELECT feature, value, a, b, c, CAST((value > a)::INTEGER + (value > b)::INTEGER + (value > c)::INTEGER AS INTEGER) AS bin "
            "FROM long JOIN cuts USING (feature))",
        ],
        f"SELECT feature, bin, count(*) AS n, {r('avg(value)', 'mean', 4)}, {r('stddev_pop(value)', 'std', 4)}, "
        f"{r('CASE bin WHEN 0 THEN min(value) WHEN 1 THEN a WHEN 2 THEN b ELSE c END', 'low', 4)}, "
        f"{r('CASE bin WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE max(value) END', 'high', 4)} "
        "FROM placed GROUP BY feature, bin, a, b, c",
    )
    sql["prediction_summary"] = _with(
        [LINEAR],
        "SELECT id, CASE WHEN prediction = 1 THEN 'Fraud' ELSE 'Not Fraud' END AS class, "
        f"{r('CASE WHEN prediction = 1 THEN p ELSE 1 - p END', 'probability')} FROM scored",
    )

    sql["perturb_single"] = _with(
        [LINEAR],
        f"SELECT id, feature_pos, {r('mean', 'value')}, {r('margin - phi', 'margin')} FROM phi JOIN raw USING (id)",
    )
    sql["feature_impacts"] = _with(
        [LINEAR, RANKED, IMPACTS], f"SELECT id, rank, feature_pos, {rounded_columns(['importance', 'impact'])} FROM impacts"
    )
    both = rounded_columns(["aufc", "correlation"])
    standard = [LINEAR, RANKED, IMPACTS, row_fidelity()]
    sql["area_under_fidelity_curve"] = _with(standard, f"SELECT id, {r('aufc', 'aufc')} FROM fid")
    sql["importance_correlation"] = _with(standard, f"SELECT id, {r('correlation', 'correlation')} FROM fid")
    sql["row_fidelity"] = _with(standard, f"SELECT id, {both} FROM fid")

    def impacts_by(change: str, space: str = "p", source: str = "ranked JOIN scored USING (id)") -> str:
        moved = f"abs(p - {SIG.format('margin - ' + change)})" if space == "p" else f"abs({change})"
        return (
            f"impacts AS (SELECT id, rank, feature_pos, abs(phi) AS importance, {moved} AS impact FROM {source})"
        )

    sql["row_fidelity_margin"] = _with(
        [LINEAR, RANKED, impacts_by("phi", "margin"), row_fidelity()], f"SELECT id, {both} FROM fid"
    )
    sql["row_fidelity_zero"] = _with(
        [LINEAR, RANKED, impacts_by("(w * value / std)"), row_fidelity()], f"SELECT id, {both} FROM fid"
    )
    donors = [
        f"giving AS (SELECT id AS donor_id, row_number() OVER (ORDER BY {hash_key('42', 'id', chr(39) + 'donor' + chr(39))}, id) AS slot FROM tx)",
        f"taking AS (SELECT id, row_number() OVER (ORDER BY {hash_key('42', 'id', chr(39) + 'draw' + chr(39))}, id) AS slot FROM tx)",
        "donated AS (SELECT taking.id, feature_pos, value AS donor FROM taking JOIN giving USING (slot) JOIN long ON long.id = donor_id)",
    ]
    sql["row_fidelity_random"] = _with(
        [
            LINEAR,
            RANKED,
            *donors,
            impacts_by(
                "(w * (value - donor) / std)", "p", "ranked JOIN donated USING (id, feature_pos) JOIN scored USING (id)"
            ),
            row_fidelity(),
        ],
        f"SELECT id, {both} FROM fid",
    )
    sql["perturb_top_k"] = _with(
        [LINEAR, RANKED],
        f"SELECT id, rank AS k, {r('margin - moved', 'margin')} FROM (SELECT *, sum({MEDIAN_SHIFT}) OVER "
        "(PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moved FROM ranked) "
        "JOIN raw USING (id)",
    )
    sql["fidelity_curve"] = _with([LINEAR, RANKED, CURVE], f"SELECT id, k, {r('loss', 'loss')} FROM curve")
    sql["mean_fidelity_curve"] = _with(
        [LINEAR, RANKED, CURVE], f"SELECT k, {r('avg(loss)', 'loss')}, count(*) AS n FROM curve GROUP BY k"
    )

    def by_copy(value: str, source: str) -> str:
        return (
            f"SELECT id, rep, {r('sum(v)', 'total')}, {r('sum(v * feature_pos)', 'weighted')}, "
            f"{r('min(v)', 'least')}, {r('max(v)', 'most')} FROM (SELECT *, {value} AS v FROM {source}) GROUP BY id, rep"
        )

    sql["gaussian_noise"] = _with([LINEAR, NOISE], by_copy("0.01 * g", "noise"))
    sql["uniform_noise"] = _with([LINEAR, NOISE, FLAT], by_copy("0.01 * (u - 0.5) * sqrt(12)", "flat"))
    sql["relative_noise"] = _with(
        [LINEAR, NOISE], by_copy("0.01 * abs(value) * g / std", "noise JOIN phi USING (id, feature_pos)")
    )
    sql["explain_noisy_copies"] = _with([LINEAR, PAIRS], by_copy("phi_copy", "pairs"))
    jaccards = rounded_columns(["jaccard_5", "jaccard_10", "jaccard_20"])
    similar = [LINEAR, PAIRS, SIMILAR]
    sql["cosine_similarity"] = _with(similar, f"SELECT id, rep, {r('cosine', 'cosine')} FROM similar_pairs")
    sql["jaccard_index"] = _with(similar, f"SELECT id, rep, {jaccards} FROM similar_pairs")
    sql["pair_stability"] = _with(similar, f"SELECT id, rep, {r('cosine', 'cosine')}, {jaccards} FROM similar_pairs")
    sql["row_stability"] = _with([*similar, STABLE], f"SELECT id, {r('cosine', 'cosine')}, {jaccards} FROM stab")

    scores = ["aufc", "correlation", "cosine", "jaccard_5", "jaccard_10", "jaccard_20"]
    everything = [*standard, PAIRS, SIMILAR, STABLE]
    joined = f"both_scores AS (SELECT id, {rounded_columns(scores)} FROM fid JOIN stab USING (id))"
    by_metric = "ml AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM both_scores" for m in scores) + ")"
    sql["score_histograms"] = _with(
        [*everything, joined, by_metric, "lim AS (SELECT metric, min(value) AS low, max(value) AS high FROM ml GROUP BY metric)"],
        f"SELECT metric, {BUCKET.format(b=20)} AS bucket, count(*) AS n FROM ml JOIN lim USING (metric) "
        "WHERE value IS NOT NULL GROUP BY ALL",
    )
    unrounded = "both_scores AS (SELECT * FROM fid JOIN stab USING (id))"
    sql["metric_means"] = _with(
        [*everything, unrounded, by_metric],
        f"SELECT metric, {r('avg(value)', 'mean')}, count(value) AS n, count(*) FILTER (value IS NULL) AS n_undefined FROM ml GROUP BY metric",
    )
    return sql


ORACLES = build()
