"""Queries over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators.labels import infer_labels
from .operators.order import search_values
from .operators.rules import Rule, checklist_rule
from .plans.table import Table, saved
from .plans.workspace import Workspace
from .sources import delimited, files

Query = Callable[[SparkSession, str], DataFrame]

#: A unique key of each table: the order of its rows.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str, **columns) -> Table:
    """A table, or some expressions over it; its key stays."""
    df = _read(spark, sf_dir, name)
    if columns:
        df = df.select(KEYS[name], *(F.expr(e).alias(c) for c, e in columns.items()))
    return Table.from_dataframe(df, [KEYS[name]])


def _filter(name: str, *rules: Rule, conjunction: str = "AND") -> Query:
    return lambda spark, sf: _table(spark, sf, name).filter(rules, conjunction).to_df()


def _sorted(name: str, *sorts: tuple[str, bool], columns: tuple[str, ...] = (), rules: tuple[Rule, ...] = (), **made) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = _table(spark, sf, name, **made).filter(rules)
        for by, descending in sorts:
            t = t.sort(by, descending)
        return t.positions().select(KEYS[name], *columns, "pos")

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a status over a price, with their customers, the dearest first."""
    orders = _table(spark, sf_dir, "orders").filter([Rule("o_orderstatus", "equals", "f"), Rule("o_totalprice", "gt", "100000")])
    both = Table.from_dataframe(orders.to_df(), ["o_orderkey"]).join(_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "inner", unique_other=True)
    return Table.from_dataframe(both, ["o_orderkey"]).sort("o_totalprice", True).page(0, 1000)


def _filter_is_empty(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "orders", prio=EXPRESSIONS["blank_priority"])
    return t.filter([Rule("prio", "is_empty")]).to_df()


def _filter_count(spark: SparkSession, sf: str) -> DataFrame:
    lines = Table.from_dataframe(_read(spark, sf, "lineitem"), ["l_orderkey"]).filter([Rule("l_quantity", "gt", "45")])
    return lines.to_df().agg(F.count("*").alias("n"))


def _unique(name: str, by: str, sample_rows: int | None = None) -> Query:
    return lambda spark, sf: _table(spark, sf, name).unique(by, sample_rows)


def _fill(name: str, column: str, expression: str, kind: str, value: str = "", as_name: str | None = None) -> Query:
    made = as_name or column
    return lambda spark, sf: _table(spark, sf, name, **{made: expression}).fill_missing(made, kind, value, sample_rows=None)


def _join(a: str, b: str, key_a: str, key_b: str, kind: str, keep_a: tuple[str, ...] = (), keep_b: tuple[str, ...] = (), where_a: str = "true", unique: bool = True) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        left, right = _read(spark, sf, a).where(where_a), _read(spark, sf, b)
        left = left.select(*keep_a) if keep_a else left
        right = right.select(*dict.fromkeys([key_b, KEYS[b], *keep_b])) if keep_b else right
        out = Table.from_dataframe(left, [KEYS[a]]).join(Table.from_dataframe(right, [KEYS[b]]), key_a, key_b, kind, unique_other=unique)
        return out.select(*left.columns, *(f"{c}_b" for c in keep_b)) if keep_b else out

    return run


def _edit_append(spark: SparkSession, sf: str) -> DataFrame:
    t = Table.from_dataframe(_read(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name"), ["r_regionkey"])
    return t.edit(6, "r_name", "NEW").to_df()


def _save_overlay(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "nation", n_name="n_name").edit(3, "n_name", "DRAFT").edit(3, "n_name", "EDITED")
    return delimited.read_csv(spark, saved(t, "save-overlay"))[0]


def _split_files(split_by: str, **options) -> Query:
    """Orders written as parts and read back: each row's part, by its file's name, and its place in it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        folder = files.scratch(spark, "split-files")
        t = _table(spark, sf, "orders", o_orderpriority="o_orderpriority", o_totalprice="o_totalprice")
        paths = t.write_split(folder, split_by, **options)
        back = spark.read.csv(paths, header=True, schema="o_orderkey long, o_orderpriority string, o_totalprice double")
        name = F.regexp_extract("_metadata.file_path", r"/table_(?:part_)?([^/]+)\.csv", 1)
        place = F.row_number().over(Window.partitionBy("part").orderBy("at")).cast("long")
        return back.select("*", name.alias("part"), F.monotonically_increasing_id().alias("at")).withColumn("place", place).drop("at")

    return run


def _odd_names(*rules: Rule, conjunction: str = "AND") -> Query:
    return lambda spark, sf: _table(spark, sf, "part", v=EXPRESSIONS["odd_name"]).filter(rules, conjunction).to_df()


def _scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = files.scratch(spark, "scan-csv")
    delimited.write_csv(_read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, ";")
    return Table.open(spark, path, multi_line=False).to_df()


def _scan_csv_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, with their line ends and quotes, through one file that is read by blocks."""
    path = files.scratch(spark, "scan-multiline")
    texts = _table(spark, sf, "documents", text="concat(coalesce(text, ''), '\n\"', source, '\",\n')", lang="lang")
    texts.save(path)
    return Table.open(spark, path).rows


def _save_own(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as a file that is opened, edited, appended to and saved over itself, edited and saved again, and read on by the same session."""
    path = files.scratch(spark, "own")
    delimited.write_csv(_read(spark, sf, "region").select("r_regionkey", "r_name"), path)
    work = Workspace(spark)
    at = work.open(path)
    for row, name, value in ((1, "r_name", "EDITED, twice"), (6, "r_name", "NEW"), (7, "r_regionkey", "7")):
        work.update_cell(at, row, name, value)
        work.save(at)
    return work[at].positions()


def _edit_many(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth order's priority and every seventh one's price edited from a frame, some twice."""
    t = _table(spark, sf, "orders", o_orderpriority="o_orderpriority", o_totalprice="o_totalprice")
    rows = t.numbered.select(F.col("_row_idx").alias("row"))
    edits = rows.where("row % 5 = 0").selectExpr("row", "'o_orderpriority' AS column", "concat('edit ', row) AS value", "0 AS at")
    again = rows.where("row % 10 = 0").selectExpr("row", "'o_orderpriority'", "'again'", "1")
    price = rows.where("row % 7 = 0").selectExpr("row", "'o_totalprice'", "cast(row + 0.5 AS string)", "2")
    return t.edit_many(edits.union(again).union(price), seq="at").to_df()


def _stored_page(spark: SparkSession, sf: str) -> DataFrame:
    """The middle of a sorted view that was written once."""
    t = _table(spark, sf, "orders").sort("o_totalprice", True).stored()
    return t.page(t.count() // 2, 100)


def _long_list(conjunction: str) -> Query:
    """Rules with every third value of a column, up to 50,000 as a checklist has them."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = _table(spark, sf, "orders", o_orderstatus="o_orderstatus", o_totalprice="o_totalprice", key="concat('Order ', o_orderkey)")
        values = [r.v for r in t.unique_values("key").collect()]  # as many as a checklist shows
        checked = [v for v in values if int(v.split()[1]) % 3 == 0]
        return t.filter([Rule("o_orderstatus", "equals", "f"), *checklist_rule([], "key", values, checked), Rule("o_totalprice", "gt", "200000")], conjunction).to_df()

    return run


def _open_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What opening a file finds out: its columns and their labels, delimiter, encoding and rows."""
    path = files.scratch(spark, "metadata")
    delimited.write_csv(_read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate")), path, "|")
    m = Table.open(spark, path).metadata()
    return spark.createDataFrame([(*c, m.delimiter, m.encoding, m.total_rows, m.total_fields) for c in m.columns], "name string, data_type string, delimiter string, encoding string, total_rows long, total_fields long")


def _command_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Orders through the cleaning commands, each of which writes the file that the next one opens."""
    folder, work = files.scratch(spark, "clean"), Workspace(spark)
    rows = _read(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", f"concat(' ', {EXPRESSIONS['blank_priority']}) AS prio", "o_totalprice")
    at = work.add("orders", rows, ["o_orderkey"])
    steps = (("deduplicate", {"keys": ["o_custkey", "prio"]}), ("trim", {"names": ["prio"]}), ("fill_missing", {"name": "prio", "kind": "Mode", "sample_rows": None}))
    for n, (kind, params) in enumerate(steps):
        at = work.open(work.clean(at, kind, f"{folder}/{n}", **params))
    return work[at].to_df()


def _command_join(spark: SparkSession, sf: str) -> DataFrame:
    """The outer join command on files, a third of whose lines have one key."""
    folder, work = files.scratch(spark, "join"), Workspace(spark)
    key = "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey * 20 END AS k"
    delimited.write_csv(_read(spark, sf, "lineitem").selectExpr(key, "l_orderkey", "l_linenumber", "l_partkey"), f"{folder}/a")
    delimited.write_csv(_read(spark, sf, "customer").select("c_custkey", "c_name"), f"{folder}/b", ";")
    path = work.join(work.open(f"{folder}/a"), "k", work.open(f"{folder}/b"), "c_custkey", "outer", f"{folder}/c")
    return Table.open(spark, path).to_df()


def _discard(spark: SparkSession, sf: str) -> DataFrame:
    """Parts after edits, appended ones too, were thrown away."""
    t = _table(spark, sf, "part", p_name="p_name").edit(3, "p_name", "EDITED")
    return t.edit(10_000_000, "p_name", "NEW").discard().to_df()


def _table_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "orders")
    return t.to_df().agg(F.count("*").alias("total_rows"), (F.count("*") * len(t.base.columns)).alias("total_fields"))


def _infer_mixed(spark: SparkSession, sf: str) -> DataFrame:
    made = {"v": EXPRESSIONS["odd_customer"], "prio": EXPRESSIONS["blank_priority"], "b": "CASE WHEN o_orderkey % 3 = 0 THEN 'TRUE' ELSE o_orderstatus END", "d": "CASE WHEN o_orderkey % 2 = 0 THEN '1/2/2024' ELSE '12' END"}
    t = _table(spark, sf, "orders", **made)
    return infer_labels(t.base, [F.col("o_orderkey")])


EXPRESSIONS = {
    "blank_priority": "CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END",
    "missing_size": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END",
    "missing_brand": "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END",
    "odd_name": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN concat('Élan ', p_name) WHEN 3 THEN concat('ÜBER', p_name, ' ß') ELSE concat(' ', p_name, '\u3000') END",
    "odd_customer": "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END",
}


def queries() -> dict[str, Query]:
    return {
        "filter_equals": _filter("customer", Rule("c_mktsegment", "equals", "building")),
        "filter_contains": _filter("part", Rule("p_name", "contains", "RED")),
        "filter_starts_with": _filter("part", Rule("p_type", "starts_with", "eco")),
        "filter_ends_with": _filter("part", Rule("p_name", "ends_with", "WIDGET")),
        "filter_is_empty": _filter_is_empty,
        "filter_regex": _filter("part", Rule("p_brand", "regex", "^Brand#1[0-9]$")),
        "filter_num_eq": _filter("part", Rule("p_size", "eq", "11.0")),
        "filter_num_ne": _filter("part", Rule("p_size", "ne", "11")),
        "filter_text_ne": _filter("orders", Rule("o_orderstatus", "not_equals", "f")),
        "filter_gt": _filter("orders", Rule("o_totalprice", "gt", "400000")),
        "filter_lt": _filter("customer", Rule("c_acctbal", "lt", "0")),
        "filter_in_json": _filter("events", Rule("event_type", "in", '["click", "PURCHASE"]')),
        "filter_in_csv": _filter("documents", Rule("lang", "in", "EN, de")),
        "filter_and": _filter("orders", Rule("o_orderstatus", "equals", "f"), Rule("o_totalprice", "gt", "300000")),
        "filter_or": _filter("orders", Rule("o_orderstatus", "equals", "f"), Rule("o_totalprice", "gt", "300000"), conjunction="OR"),
        "filter_no_rules": _filter("nation"),
        "filter_unknown_column": _filter("orders", Rule("o_totalprice", "gt", "400000"), Rule("no_such_column", "equals", "x")),
        "filter_count": _filter_count,
        "sort_text_asc": _sorted("part", ("p_name", False), columns=("p_name",)),
        "sort_text_desc": _sorted("part", ("p_name", True), columns=("p_name",)),
        "sort_numeric_asc": _sorted("customer", ("c_acctbal", False), columns=("c_acctbal",)),
        "sort_numeric_desc": _sorted("orders", ("v", True), columns=("v",), v=EXPRESSIONS["odd_customer"]),
        "sort_chained": _sorted("orders", ("o_totalprice", True), ("o_orderpriority", False)),
        "sort_filtered": _sorted("orders", ("o_totalprice", True), rules=(Rule("o_orderstatus", "equals", "f"),)),
        "page": lambda spark, sf: _table(spark, sf, "orders").page(200, 100),
        "unique_text": _unique("customer", "c_mktsegment"),
        "unique_numeric": _unique("part", "p_size"),
        "unique_capped": lambda spark, sf: _table(spark, sf, "events").unique_values("user_id", 500),
        "unique_search": lambda spark, sf: search_values(_table(spark, sf, "part").unique_values("p_type", None), "AN"),
        "dedupe_single": lambda spark, sf: _table(spark, sf, "orders").dedupe(["o_custkey"]),
        "dedupe_composite": lambda spark, sf: _table(spark, sf, "events").dedupe(["user_id", "event_type"]),
        "dedupe_text": lambda spark, sf: _table(spark, sf, "documents").dedupe(["text"]).select("doc_id", "lang", "source"),
        "trim_columns": lambda spark, sf: _table(spark, sf, "part", p_name="concat('  ', p_name, ' ')").trim(["p_name", "no_such_column"]),
        "fill_value": _fill("orders", "prio", EXPRESSIONS["blank_priority"], "Value", "UNKNOWN"),
        "fill_mean": _fill("part", "sz", EXPRESSIONS["missing_size"], "Mean"),
        "fill_median": _fill("part", "sz", EXPRESSIONS["missing_size"], "Median"),
        "fill_mode": _fill("part", "b", EXPRESSIONS["missing_brand"], "Mode"),
        "fill_drop": _fill("orders", "prio", EXPRESSIONS["blank_priority"], "Drop"),
        "join_inner": _join("supplier", "nation", "s_nationkey", "n_nationkey", "inner"),
        "join_left": _join("customer", "supplier", "c_custkey", "s_suppkey", "left", ("c_custkey", "c_name"), ("s_name",)),
        "join_right": _join("supplier", "customer", "s_suppkey", "c_custkey", "right", ("s_suppkey", "s_name"), ("c_name",)),
        "join_outer": _join("part", "customer", "p_partkey", "c_custkey", "outer", ("p_partkey", "p_name"), ("c_name",), where_a="p_partkey >= 500"),
        "join_last_wins": _join("customer", "orders", "c_custkey", "o_custkey", "inner", ("c_custkey", "c_name"), ("o_orderkey", "o_orderpriority"), unique=False),
        "join_last_wins_left": _join("customer", "orders", "c_custkey", "o_custkey", "left", ("c_custkey", "c_name"), ("o_orderpriority",), unique=False),
        "join_last_wins_right": _join("customer", "orders", "c_custkey", "o_custkey", "right", ("c_custkey", "c_name"), ("o_orderkey", "o_orderpriority"), where_a="c_custkey % 3 = 0", unique=False),
        "join_last_wins_outer": _join("customer", "orders", "c_custkey", "o_custkey", "outer", ("c_custkey", "c_name"), ("o_orderpriority",), where_a="c_custkey % 3 = 0", unique=False),
        "filter_equals_accents": _odd_names(Rule("v", "equals", "élan red widget")),
        "filter_equals_ascii_case": _odd_names(Rule("v", "equals", "Élan RED widget")),
        "filter_contains_accents": _odd_names(Rule("v", "contains", "über")),
        "filter_starts_with_accents": _odd_names(Rule("v", "starts_with", "Él")),
        "filter_ends_with_accents": _odd_names(Rule("v", "ends_with", " ß")),
        "filter_blank_or_missing": _odd_names(Rule("v", "is_empty")),
        "filter_not_equals_missing": _odd_names(Rule("v", "not_equals", "x")),
        "split_rows_files": _split_files("rows", row_limit=4000),
        "split_column_files": _split_files("column", column_name="o_orderpriority", one_file=True),
        "split_rows": lambda spark, sf: _table(spark, sf, "orders").split_rows(4000).groupBy("part").agg(F.count("*").alias("n")),
        "split_column": lambda spark, sf: _table(spark, sf, "orders").split_by("o_orderpriority").groupBy("part").agg(F.count("*").alias("n")),
        "edit_overlay": lambda spark, sf: _table(spark, sf, "nation", n_name="n_name").edit(3, "n_name", "EDITED").to_df(),
        "edit_append": _edit_append,
        "save_overlay": _save_overlay,
        "scan_csv": _scan_csv,
        "scan_csv_multiline": _scan_csv_multiline,
        "save_over_own_file": _save_own,
        "edit_many": _edit_many,
        "page_stored": _stored_page,
        "filter_in_long_and": _long_list("AND"),
        "filter_in_long_or": _long_list("OR"),
        "filter_regex_classes": _filter("part", Rule("p_name", "regex", r"^[[:alpha:]--[a-m]]++[^\S\n](?i:WIDG|[x-z])\w{2}\b"), Rule("p_type", "regex", r"(?x) ^ (?P<kind> [A-Z&&[^AEIOU]] ) [[:upper:]~~O] # a comment"), conjunction="OR"),
        "open_metadata": _open_metadata,
        "discard_edits": _discard,
        "command_clean": _command_clean,
        "command_join": _command_join,
        "table_stats": _table_stats,
        "infer_types": lambda spark, sf: infer_labels(_read(spark, sf, "events"), [F.col("event_id")]),
        "infer_types_mixed": _infer_mixed,
    }


def _labels_sql(source: str, key: str, names: tuple[str, ...]) -> str:
    """The vote of the first hundred rows on each column's label."""
    cells = ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)
    return f"""
WITH s AS (SELECT {cells} FROM {source} t ORDER BY t.{key} LIMIT 100),
c AS (SELECT name, trim(v) AS v FROM (UNPIVOT s ON {", ".join(names)} INTO NAME name VALUE v)),
l AS (SELECT name, CASE WHEN v = '' THEN NULL WHEN lower(v) IN ('true', 'false') THEN 'Boolean' WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'Numeric'
  WHEN (length(v) - length(replace(v, '-', '')) = 2 OR length(v) - length(replace(v, '/', '')) = 2) AND strlen(v) >= 8 THEN 'Datetime' ELSE 'String' END AS label FROM c),
n AS (SELECT name, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL)
SELECT name, label AS data_type FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, list_position(['Numeric', 'Datetime', 'Boolean', 'String'], label)) = 1"""


def oracle_sql() -> dict[str, str]:
    accents = EXPRESSIONS["odd_name"]
    listed = "SELECT o_orderkey, o_orderstatus, o_totalprice, concat('Order ', o_orderkey) AS key, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders"
    prio, size, brand, odd = (EXPRESSIONS[k].replace("STRING", "VARCHAR") for k in ("blank_priority", "missing_size", "missing_brand", "odd_customer"))
    return {
        "filter_equals": "SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'",
        "filter_contains": "SELECT * FROM part WHERE contains(lower(p_name), 'red')",
        "filter_starts_with": "SELECT * FROM part WHERE starts_with(lower(p_type), 'eco')",
        "filter_ends_with": "SELECT * FROM part WHERE ends_with(lower(p_name), 'widget')",
        "filter_is_empty": f"SELECT * FROM (SELECT o_orderkey, {prio} AS prio FROM orders) WHERE trim(prio) = ''",
        "filter_regex": "SELECT * FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-9]$')",
        "filter_num_eq": "SELECT * FROM part WHERE abs(CAST(p_size AS DOUBLE) - 11) < 2.220446049250313e-16",
        "filter_num_ne": "SELECT * FROM part WHERE abs(CAST(p_size AS DOUBLE) - 11) >= 2.220446049250313e-16",
        "filter_text_ne": "SELECT * FROM orders WHERE lower(o_orderstatus) <> 'f'",
        "filter_gt": "SELECT * FROM orders WHERE o_totalprice > 400000",
        "filter_lt": "SELECT * FROM customer WHERE c_acctbal < 0",
        "filter_in_json": "SELECT * FROM events WHERE lower(event_type) IN ('click', 'purchase')",
        "filter_in_csv": "SELECT * FROM documents WHERE lower(lang) IN ('en', 'de')",
        "filter_and": "SELECT * FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice > 300000",
        "filter_or": "SELECT * FROM orders WHERE lower(o_orderstatus) = 'f' OR o_totalprice > 300000",
        "filter_no_rules": "SELECT * FROM nation",
        "filter_unknown_column": "SELECT * FROM orders WHERE o_totalprice > 400000",
        "filter_count": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 45",
        "sort_text_asc": "SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS pos FROM part",
        "sort_text_desc": "SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name) DESC, p_partkey) AS pos FROM part",
        "sort_numeric_asc": "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos FROM customer",
        "sort_numeric_desc": f"SELECT o_orderkey, v, row_number() OVER (ORDER BY (TRY_CAST(v AS DOUBLE) IS NULL), TRY_CAST(v AS DOUBLE) DESC, o_orderkey) AS pos FROM (SELECT o_orderkey, {odd} AS v FROM orders)",
        "sort_chained": "SELECT o_orderkey, row_number() OVER (ORDER BY lower(o_orderpriority), o_totalprice DESC, o_orderkey) AS pos FROM orders",
        "sort_filtered": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders WHERE lower(o_orderstatus) = 'f'",
        "page": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200",
        "unique_text": "SELECT v, row_number() OVER (ORDER BY v) AS pos FROM (SELECT DISTINCT trim(c_mktsegment) AS v FROM customer)",
        "unique_numeric": "SELECT v, row_number() OVER (ORDER BY v) AS pos FROM (SELECT DISTINCT p_size AS v FROM part)",
        "unique_capped": "SELECT DISTINCT user_id AS v FROM (SELECT user_id FROM events ORDER BY event_id LIMIT 500)",
        "unique_search": "SELECT v FROM (SELECT DISTINCT trim(p_type) AS v FROM part) WHERE contains(lower(v), 'an')",
        "dedupe_single": "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
        "dedupe_composite": "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
        "dedupe_text": "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
        "trim_columns": "SELECT p_partkey, trim('  ' || p_name || ' ') AS p_name FROM part",
        "fill_value": f"SELECT o_orderkey, CASE WHEN trim(prio) = '' THEN 'UNKNOWN' ELSE prio END AS prio FROM (SELECT o_orderkey, {prio} AS prio FROM orders)",
        "fill_mean": f"WITH d AS (SELECT p_partkey, {size} AS sz FROM part) SELECT p_partkey, coalesce(CAST(sz AS DOUBLE), (SELECT avg(sz) FROM d)) AS sz FROM d",
        "fill_median": f"WITH d AS (SELECT p_partkey, {size} AS sz FROM part) SELECT p_partkey, coalesce(CAST(sz AS DOUBLE), (SELECT median(sz) FROM d)) AS sz FROM d",
        "fill_mode": f"WITH d AS (SELECT p_partkey, {brand} AS b FROM part), m AS (SELECT b FROM d WHERE b <> '' GROUP BY b ORDER BY count(*) DESC, b LIMIT 1) SELECT p_partkey, CASE WHEN b = '' THEN (SELECT b FROM m) ELSE b END AS b FROM d",
        "fill_drop": "SELECT o_orderkey, o_orderpriority AS prio FROM orders WHERE o_orderkey % 7 <> 0",
        "join_inner": "SELECT s.*, n_name AS n_name_b, n_regionkey AS n_regionkey_b FROM supplier s JOIN nation ON s_nationkey = n_nationkey",
        "join_left": "SELECT c_custkey, c_name, coalesce(s_name, '') AS s_name_b FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
        "join_right": "SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, coalesce(s_name, '') AS s_name, c_name AS c_name_b FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey",
        "join_outer": "SELECT coalesce(p_partkey, c_custkey) AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(c_name, '') AS c_name_b FROM (SELECT * FROM part WHERE p_partkey >= 500) p FULL JOIN customer ON p_partkey = c_custkey",
        "join_last_wins": "WITH b AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey, c_name, o_orderkey AS o_orderkey_b, o_orderpriority AS o_orderpriority_b FROM customer JOIN b ON c_custkey = o_custkey",
        "join_last_wins_left": "WITH b AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey, c_name, coalesce(o_orderpriority, '') AS o_orderpriority_b FROM customer LEFT JOIN b ON c_custkey = o_custkey",
        "join_last_wins_right": "WITH b AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT o_custkey AS c_custkey, coalesce(c_name, '') AS c_name, o_orderkey AS o_orderkey_b, o_orderpriority AS o_orderpriority_b FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) c RIGHT JOIN b ON c_custkey = o_custkey",
        "join_last_wins_outer": "WITH b AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(c_name, '') AS c_name, coalesce(o_orderpriority, '') AS o_orderpriority_b FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) c FULL JOIN b ON c_custkey = o_custkey",
        "filter_equals_accents": f"SELECT * FROM (SELECT p_partkey, {accents} AS v FROM part) WHERE translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'élan red widget'",
        "filter_equals_ascii_case": f"SELECT * FROM (SELECT p_partkey, {accents} AS v FROM part) WHERE translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'Élan red widget'",
        "filter_contains_accents": f"SELECT * FROM (SELECT p_partkey, {accents} AS v FROM part) WHERE contains(lower(v), 'über')",
        "filter_starts_with_accents": f"SELECT * FROM (SELECT p_partkey, {accents} AS v FROM part) WHERE starts_with(lower(v), 'él')",
        "filter_ends_with_accents": f"SELECT * FROM (SELECT p_partkey, {accents} AS v FROM part) WHERE ends_with(lower(v), ' ß')",
        "filter_blank_or_missing": f"SELECT * FROM (SELECT p_partkey, {accents} AS v FROM part) WHERE coalesce(v, '') = ''",
        "filter_not_equals_missing": f"SELECT * FROM (SELECT p_partkey, {accents} AS v FROM part) WHERE lower(coalesce(v, '')) <> 'x'",
        "split_rows_files": "SELECT o_orderkey, o_orderpriority, o_totalprice, CAST((n - 1) // 4000 + 1 AS VARCHAR) AS part, (n - 1) % 4000 + 1 AS place FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)",
        "split_column_files": r"SELECT o_orderkey, o_orderpriority, o_totalprice, part, row_number() OVER (PARTITION BY part ORDER BY o_orderkey) AS place FROM (SELECT *, regexp_replace(o_orderpriority, '[^\p{L}\p{N}]', '_', 'g') AS part FROM orders)",
        "split_rows": "SELECT part, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 + 1 AS part FROM orders) GROUP BY part",
        "split_column": r"SELECT CASE WHEN k = '' THEN 'empty' ELSE k END AS part, count(*) AS n FROM (SELECT regexp_replace(o_orderpriority, '[^\p{L}\p{N}]', '_', 'g') AS k FROM orders) GROUP BY 1",
        "edit_overlay": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'EDITED' ELSE n_name END AS n_name FROM nation",
        "edit_append": "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region UNION ALL SELECT '', '' UNION ALL SELECT '', 'NEW'",
        "save_overlay": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'EDITED' ELSE n_name END AS n_name FROM nation",
        "scan_csv": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer",
        "scan_csv_multiline": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _row_idx, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') || chr(10) || '"' || source || '",' || chr(10) AS text, lang FROM documents""",
        "save_over_own_file": "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, CASE WHEN r_regionkey = 1 THEN 'EDITED, twice' ELSE r_name END AS r_name, CAST(r_regionkey + 1 AS BIGINT) AS pos FROM region UNION ALL SELECT '', '', 6 UNION ALL SELECT '', 'NEW', 7 UNION ALL SELECT '7', '', 8",
        "edit_many": "SELECT o_orderkey, CASE WHEN r % 10 = 0 THEN 'again' WHEN r % 5 = 0 THEN 'edit ' || r ELSE o_orderpriority END AS o_orderpriority, CASE WHEN r % 7 = 0 THEN r + 0.5 ELSE o_totalprice END::DOUBLE AS o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)",
        "page_stored": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET (SELECT count(*) // 2 FROM orders)",
        "filter_in_long_and": f"SELECT * EXCLUDE (n) FROM ({listed}) WHERE lower(o_orderstatus) = 'f' AND n <= 50000 AND o_orderkey % 3 = 0 AND o_totalprice > 200000",
        "filter_in_long_or": f"SELECT * EXCLUDE (n) FROM ({listed}) WHERE lower(o_orderstatus) = 'f' OR n <= 50000 AND o_orderkey % 3 = 0 OR o_totalprice > 200000",
        "filter_regex_classes": r"SELECT * FROM part WHERE regexp_matches(p_name, '^[A-Zn-z]+[ \t](?i:WIDG|[x-z])[0-9A-Za-z_]{2}\b') OR regexp_matches(p_type, '^[B-DF-HJ-NP-TV-Z][A-NP-Z]')",
        "open_metadata": "SELECT name, data_type, '|' AS delimiter, 'UTF-8' AS encoding, n AS total_rows, n * 4 AS total_fields FROM (VALUES ('o_orderkey', 'Numeric'), ('o_orderstatus', 'String'), ('o_orderpriority', 'String'), ('o_orderdate', 'Datetime')) t(name, data_type), (SELECT count(*) AS n FROM orders)",
        "command_clean": f"WITH d AS (SELECT o_orderkey, o_custkey, trim({prio}) AS p, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, p ORDER BY o_orderkey) = 1), m AS (SELECT p FROM d WHERE p <> '' GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CASE WHEN p = '' THEN (SELECT p FROM m) ELSE p END AS prio, TRY_CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM d",
        "command_join": "WITH a AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey * 20 END AS k, l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT CAST(coalesce(k, c_custkey) AS VARCHAR) AS k, coalesce(CAST(l_orderkey AS VARCHAR), '') AS l_orderkey, coalesce(CAST(l_linenumber AS VARCHAR), '') AS l_linenumber, coalesce(CAST(l_partkey AS VARCHAR), '') AS l_partkey, coalesce(c_name, '') AS c_name_b FROM a FULL JOIN customer ON k = c_custkey",
        "discard_edits": "SELECT p_partkey, p_name FROM part",
        "table_stats": "SELECT count(*) AS total_rows, count(*) * 6 AS total_fields FROM orders",
        "infer_types": _labels_sql("events", "event_id", ("event_id", "ts", "user_id", "event_type", "value", "props")),
        "infer_types_mixed": _labels_sql(f"(SELECT o_orderkey, {odd} AS v, {prio} AS prio, CASE WHEN o_orderkey % 3 = 0 THEN 'TRUE' ELSE o_orderstatus END AS b, CASE WHEN o_orderkey % 2 = 0 THEN '1/2/2024' ELSE '12' END AS d FROM orders)", "o_orderkey", ("o_orderkey", "v", "prio", "b", "d")),
    }
