"""The registered queries over the relational test tables, and their SQL.

Each query builds document tables from relations and reads them back with a pattern; the SQL
states the same result on the relations.  Every value of a record is a string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators import transforms
from gridweave.operators.chunked import extract_rows
from gridweave.operators.extract import extract, matching
from gridweave.operators.items import items
from gridweave.operators.records import Options, records
from gridweave.plans import dsl as d
from gridweave.plans import fluent
from gridweave.plans.rtl import Bindings, compile_pattern
from gridweave.sources.grids import cells, csv_grid, dealt, fill_merged, grid_of_rows, grid_of_text
from gridweave.sources.sinks import csv_line

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


def _query(sql: str):
    def registered(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return registered


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(df: DataFrame, *names: str) -> DataFrame:
    """table_id and the fields under these names."""
    return df.drop("rec_no").toDF("table_id", *names)


def crosstab_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a crosstab of order counts: priorities down, statuses across."""
    orders = _read(spark, sf_dir, "orders")
    count = lambda p, s: F.count_if((F.col("o_orderpriority") == p) & (F.col("o_orderstatus") == s)).cast("string")
    wide = dealt(orders.select("o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey").groupBy("o_custkey").agg(*(count(p, s).alias(f"n{i}{j}") for i, p in enumerate(PRIORITIES) for j, s in enumerate(STATUSES)))
    head = F.array(F.lit(""), *map(F.lit, STATUSES))
    rows = (F.array(F.lit(p), *(F.col(f"n{i}{j}") for j in range(len(STATUSES)))) for i, p in enumerate(PRIORITIES))
    return wide.select(F.col("o_custkey").alias("table_id"), F.array(head, *rows).alias("grid"))


CROSSTAB = """
    [ [] [VAL : 'STATUS'->AVP]+ ]
    [ [VAL : 'PRIORITY'->AVP] [VAL : 'N'->AVP, (COL, ROW)->REC]+ ]+"""


@_query("""select c.o_custkey as table_id, count(o.o_orderkey)::varchar as n, s.status, p.priority
    from (select distinct o_custkey from orders) c cross join (select unnest(['F', 'O', 'P']) as status) s
    cross join (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) as priority) p
    left join orders o on o.o_custkey = c.o_custkey and o.o_orderstatus = s.status and o.o_orderpriority = p.priority
    group by all""")
def crosstab_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(extract(crosstab_grids(spark, sf_dir), CROSSTAB, ["N", "STATUS", "PRIORITY"]), "n", "status", "priority")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab_unpivot(spark, sf_dir)


@_query("select o_orderkey as table_id, o_orderkey::varchar as orderkey, o_orderstatus as status, o_orderpriority as priority from orders")
def rec_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    found = extract(grids, "[ [VAL : 'KEY'->AVP, RT*->REC] [VAL : 'STATUS'->AVP] [VAL : 'PRIORITY'->AVP] ]", ["KEY", "STATUS", "PRIORITY"])
    return _named(found, "orderkey", "status", "priority")


@_query("select r_regionkey as table_id, n_nationkey::varchar as nationkey, n_name as name from nation join region on n_regionkey = r_regionkey")
def header_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"], header=True)
    found = extract(grids, "[ [ATTR]+ ] [ [VAL : COL->AVP, RT*->REC] [VAL : COL->AVP]+ ]+", ["n_nationkey", "n_name"])
    return _named(found, "nationkey", "name")


@_query("select user_id as table_id, event_id::varchar as event, event_type as type from events")
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are written only where they change; FILL takes the nearest one above."""
    from pyspark.sql import Window

    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    ditto = events.withColumn("shown", F.when(F.col("event_type").eqNullSafe(before), "").otherwise(F.col("event_type")))
    grids = grid_of_rows(ditto, ["user_id"], ["event_id"], ["event_id", "shown"])
    found = extract(grids, "[ [VAL : 'EVENT'->AVP, RT->REC] [BLANK ? VAL : -AV&!BLANK->FILL, 'TYPE'->AVP | VAL : 'TYPE'->AVP] ]+", ["EVENT", "TYPE"])
    return _named(found, "event", "type")


@_query("""select conv_id as table_id, turn::varchar as turn,
    coalesce(lag(role) over w || '<', '') || role || coalesce('>' || lead(role) over w, '') as roles
    from conversations window w as (partition by conv_id order by turn)""")
def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["turn", "role"])
    found = extract(grids, "[ [VAL : 'TURN'->AVP, RT->REC] [VAL : -AV->PREFIX('<'), BW->SUFFIX('>'), 'ROLES'->AVP] ]+", ["TURN", "ROLES"])
    return _named(found, "turn", "roles")


_PARTS = [f"$a_{i}" for i in range(1, 15)]


@_query("""with r as (select l_orderkey, l_returnflag, l_linenumber, l_partkey, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey) as n
        from lineitem)
    select l_orderkey as table_id, l_returnflag as flag,
    """ + ", ".join(f"max(case when n = {i} then l_partkey::varchar end) as part{i}" for i in range(1, 14)) + " from r group by 1, 2")  # fmt: skip
def join_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an order, one row each, become one record for each return flag."""
    grids = grid_of_rows(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_returnflag", "l_partkey"])
    found = extract(grids, "[ [VAL : RT->REC, (BW&STR)*->JOIN(0)] [VAL] ]+", _PARTS)
    return _named(found, "flag", *(f"part{i}" for i in range(1, 14)))


@_query("""with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
    select o_custkey as table_id, max(case when n = 1 then o_orderkey::varchar end) as first_order, string_agg(o_orderstatus, '' order by n) as statuses, count(*) as orders from r group by 1""")
def join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order of a customer, all joined into the first, whatever its key."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    found = records(grids, compile_pattern("[ [VAL : RT->REC, ST*->JOIN(0)] [VAL] ]+"))
    rest = F.slice("members", 2, F.size("members"))
    return found.select("table_id", F.col("members")[0]["val"].alias("first_order"), F.array_join(F.transform(rest, lambda m: m["val"]), "").alias("statuses"), F.size(rest).cast("long").alias("orders"))


@_query("""with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders)
    select o_custkey as table_id, max(case when n % 2 = 0 then o_orderkey::varchar end) as first_order, max(case when n % 2 = 0 then o_orderstatus end) as status,
    max(case when n % 2 = 1 then o_orderstatus end) as next_status from r group by o_custkey, n // 2""")
def join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order takes in the next one of its customer, unless it was taken in itself."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    found = extract(grids, "[ [VAL : RT->REC, BW->JOIN(0)] [VAL] ]+", ["$a_1", "$a_2", "$a_3"])
    return _named(found, "first_order", "status", "next_status")


@_query("select p_partkey as table_id, split_part(p_brand, '#', 1) as make, split_part(p_brand, '#', 2) as number from part")
def compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey"], ["p_brand"])
    return _named(extract(grids, "[ [VAL : 'MAKE'->AVP, CL->REC '#' VAL : 'NUMBER'->AVP] ]", ["MAKE", "NUMBER"]), "make", "number")


@_query("""select p_partkey as table_id, w as word, p_partkey::varchar as part, (i - 1)::int as place
    from (select p_partkey, unnest(string_split(p_name, ' ')) as w, generate_subscripts(string_split(p_name, ' '), 1) as i from part) where trim(w) <> ''""")
def delimited_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey"], ["p_partkey", "p_name"])
    found = extract(grids, "[ [VAL : 'PART'->AVP] [(VAL : 'WORD'->AVP, (ROW&C0)->REC){' '}] ]", ["WORD", "PART"])
    return found.select("table_id", F.col("WORD").alias("word"), F.col("PART").alias("part"), F.col("rec_no").cast("int").alias("place"))


@_query("""select s_suppkey as table_id, upper(s_name) as up, lower(s_name) as low, substr(s_name, 1, 4) as cut, regexp_replace(s_name, '0+', '', 'g') as repl, s_name as trimmed,
    s_name || ' ' || s_nationkey::varchar as norm from supplier""")
def extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", *(name.alias(f"n{i}") for i in range(4)), F.concat(F.lit(" \t"), name, F.lit("  ")).alias("n4"), F.concat(F.lit("  "), name, F.lit(" \n "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("n5"))
    grids = grid_of_rows(rows, ["s_suppkey"], ["s_suppkey"], [f"n{i}" for i in range(6)])
    pattern = "[ [VAL = UC : RT*->REC] [VAL = LC] [VAL = SUBSTR(0,4)] [VAL = REPL('0+', '')] [VAL = TRIM] [VAL = NORM] ]"
    return _named(extract(grids, pattern, [f"$a_{i}" for i in range(1, 7)]), "up", "low", "cut", "repl", "trimmed", "norm")


@_query("""with n as (select o_custkey, count(*) as n from orders group by 1)
    select o_custkey as table_id, n = 3 as matched from n""")
def exact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with exactly three rows match; the others are found not to."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return matching(grids, "[ [VAL] [VAL] ]{3}").select("table_id", "matched")


@_query("""with r as (select o_custkey, o_orderkey, o_orderstatus from orders),
    ok as (select o_custkey from r group by 1 having bool_and(o_orderstatus in ('F', 'O')))
    select r.o_custkey as table_id, o_orderkey::varchar as orderkey, o_orderstatus as status from r join ok using (o_custkey)""")
def table_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guard must hold for every cell: customers with finished and open orders only."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    found = extract(grids, r"""'\d+|[FO]' ? [ [VAL : 'KEY'->AVP, RT->REC] [VAL : 'STATUS'->AVP] ]+""", ["KEY", "STATUS"])
    return _named(found, "orderkey", "status")


@_query("""select event_id as table_id, case when event_type = 'error' then null else event_type end as kind, case when event_type = 'error' then event_type end as fault, event_id::varchar as event from events""")
def conditional_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "events"), ["event_id"], ["event_id"], ["event_id", "event_type"])
    found = extract(grids, "[ [VAL : 'EVENT'->AVP, RT->REC] ['error' ? VAL : 'FAULT'->AVP | VAL : 'KIND'->AVP] ]", ["EVENT", "FAULT", "KIND"])
    return _named(found.select("table_id", "rec_no", "KIND", "FAULT", "EVENT"), "kind", "fault", "event")


@_query("""with n as (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation)
    select a.n_regionkey as table_id, a.n_name as name, b.n_name || '/' || c.n_name || coalesce('|' || d.n_name, '') as others
    from n a join n b on a.n_regionkey = b.n_regionkey and b.i = a.i - 1 join n c on a.n_regionkey = c.n_regionkey and c.i = a.i - 2
    left join n d on a.n_regionkey = d.n_regionkey and d.i = 2 and a.i <> 2
    where a.i > 2""")
def ordered_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest above, nearest first, and a fixed row, from the third row on."""
    grids = grid_of_rows(_read(spark, sf_dir, "nation").withColumn("copy", F.col("n_name")), ["n_regionkey"], ["n_nationkey"], ["copy", "n_name"])
    found = extract(grids, "[ [VAL] [VAL] ]{2} [ [VAL : RT->REC] [VAL : -AV{2}->FILL('/'), (COL&R1)->SUFFIX('|')] ]+", ["$a_1", "$a_2"])
    return _named(found, "name", "others")


@_query("""with n as (select n_regionkey, n_name, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as i, count(*) over (partition by n_regionkey) as k from nation)
    select a.n_regionkey as table_id, a.n_name as name, b.n_name as first, e.n_name as last
    from n a join n b on a.n_regionkey = b.n_regionkey and b.i = 1 join n e on a.n_regionkey = e.n_regionkey and e.i = e.k where a.i > 1 and a.i < a.k""")
def column_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last of the others by column order and its reverse; tags tell the rows apart."""
    grids = grid_of_rows(_read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_name", "n_nationkey"])
    found = extract(grids, "[ [VAL #'N'] [] ] [ [VAL #'N' : (^(NCL&#'N'), -^(NCL&#'N'))->REC] [] ]{3} [ [VAL #'N'] [] ]", ["$a_1", "$a_2", "$a_3"])
    return _named(found, "name", "first", "last")


@_query("""with n as (select n_regionkey, n_name, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as i from nation)
    select a.n_regionkey as table_id, a.n_name as name, coalesce(string_agg(b.n_name, '+' order by b.i), '') as others
    from n a left join n b on a.n_regionkey = b.n_regionkey and a.i <> b.i and (b.i between 1 and 2 or b.n_name like '%1%') group by 1, 2""")
def disjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 1 to 2, or names with a 1, joined into one text."""
    grids = grid_of_rows(_read(spark, sf_dir, "nation").withColumn("copy", F.col("n_name")), ["n_regionkey"], ["n_nationkey"], ["copy", "n_name"])
    found = extract(grids, "[ [VAL : ROW->REC] [VAL : (COL&(R1..2|~'1'))*->FILL('+')] ]+", ["$a_1", "$a_2"])
    return _named(found, "name", "others")


@_query("select o_orderkey as table_id, o_orderstatus as status, o_orderkey::varchar as orderkey, 'orders' as source, '7' as kind from orders")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant pairs and literals as members, and REC(1), which moves the anchor to position 1."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    found = extract(grids, "[ [VAL] [VAL : (LT, @'SOURCE'='orders', '7')->REC(1)] ]", ["$a_1", "$a_2", "SOURCE", "$a_4"])
    return _named(found, "orderkey", "status", "source", "kind").select("table_id", "status", "orderkey", "source", "kind")


@_query("""select r_regionkey as table_id, n_regionkey_name as region, string_agg(n_name, '/' order by n_nationkey) as nations
    from (select r_regionkey, r_name as n_regionkey_name, n_name, n_nationkey from region join nation on n_regionkey = r_regionkey) group by 1, 2""")
def suffix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    grids = grid_of_rows(nations, ["r_regionkey"], ["n_nationkey"], ["r_name", "n_name"])
    found = extract(grids, "[ [VAL : RT->REC] [VAL : BW*->SUFFIX('/')] ] [ [] [AUX] ]*", ["$a_1", "$a_2"])
    return _named(found, "region", "nations")


@_query("""select p_partkey as table_id, split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as second, p_type as type from part""")
def split_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPLIT makes columns of delimited values."""
    grids = grid_of_rows(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey"], ["p_name", "p_type"])
    return _named(extract(grids, "<SPLIT(' ')> [ [VAL : RT->REC] [VAL] ]", ["$a_1", "$a_2"]), "first", "second", "type")


@_query("""select p_partkey as table_id, p_type as type, regexp_extract(p_brand, '^([A-Za-z]+)', 1) as make, regexp_extract(p_brand, '([0-9]+)$', 1) as number from part""")
def regex_split_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey"], ["p_brand", "p_type"])
    found = extract(grids, "[ [VAL : 'BRAND'->AVP, RT->REC] [VAL : 'TYPE'->AVP] ]", ["BRAND", "TYPE"])
    found = transforms.reordered(transforms.field_split(found, "BRAND", "[^A-Za-z0-9]+", ["MAKE", "NUMBER"]), ["TYPE"])
    return _named(found, "type", "make", "number")


@_query("""select event_id as table_id, event_id::varchar as event, case when event_type = 'purchase' then 'yes' else 'no' end as bought from events""")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent fields get what a handler says for their attribute."""
    grids = grid_of_rows(_read(spark, sf_dir, "events"), ["event_id"], ["event_id"], ["event_id", "event_type"])
    pattern = "[ [VAL : 'EVENT'->AVP, RT->REC] ['purchase' ? VAL = REPL('purchase', 'yes') : 'BOUGHT'->AVP | SKIP] ]"
    return _named(extract(grids, pattern, ["EVENT", "BOUGHT"], missing=lambda a: "no" if a == "BOUGHT" else None), "event", "bought")


@_query("""select o_orderkey as table_id, o_orderkey::varchar as orderkey, o_orderstatus as status from orders where o_orderpriority <> '5-LOW'""")
def bound_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT names a function given with the pattern: of a cell's Column, and of an anchor and a candidate."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    own = Bindings().cell("pressing", lambda text: text != "5-LOW", columnar=True).pair("next", lambda a, c: c("col") == a("col") + 1, columnar=True)
    found = extract(grids, "[ [VAL : 'KEY'->AVP, (ROW&EXT('next'))->REC] [VAL : 'STATUS'->AVP] [EXT('pressing')] ]", ["KEY", "STATUS"], bindings=own)
    return _named(found, "orderkey", "status")


@_query("select r_regionkey as table_id, r_name as region, n_name as nation from region join nation on n_regionkey = r_regionkey")
def inherited_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtables and actions that all their atoms inherit."""
    nations = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    grids = grid_of_rows(nations, ["r_regionkey"], ["n_nationkey"], ["r_name", "n_name"])
    found = extract(grids, "{ [ [VAL : 'REGION'->AVP] { 'NATION'->AVP [VAL : ROW->REC] } ] }+", ["NATION", "REGION"])
    return _named(found.select("table_id", "rec_no", "REGION", "NATION"), "region", "nation")


@_query("select n_regionkey as table_id, n_nationkey::varchar as key, n_name as name from nation")
def dsl_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a text pattern, built in Python, with fields in order of position."""
    grids = grid_of_rows(_read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])
    pattern = d.table(d.row(d.cell(d.VAL, d.rec(d.RT)), d.cell(d.VAL)).one_or_more())
    assert pattern == compile_pattern("[ [VAL : RT->REC] [VAL] ]+")
    return _named(extract(grids, pattern, options=Options(schema_by="position", actions_by="column")), "key", "name")


@_query("""select c_custkey as table_id, c_custkey::varchar as key, c_name as name, c_mktsegment as segment from customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV texts and read back as grids."""
    customers = _read(spark, sf_dir, "customer")
    line = csv_line(F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.concat(F.col("c_mktsegment"), F.lit(', "x"'))))
    grids = customers.select(F.col("c_custkey").alias("table_id"), csv_grid(line).alias("grid"))
    found = extract(grids, "[ [VAL : RT*->REC] [VAL] [VAL = REPL(', .*', '')] ]", ["$a_1", "$a_2", "$a_3"])
    return _named(found, "key", "name", "segment")


@_query("""select event_id as table_id, 'k' as name, regexp_extract(props, '([0-9]+)', 1) as value from events""")
def text_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited texts as grids: `{"k": 69}` is one row of two cells."""
    events = _read(spark, sf_dir, "events")
    grids = events.select(F.col("event_id").alias("table_id"), grid_of_text(F.col("props"), ",", ":").alias("grid"))
    pattern = r"""[ [VAL = REPL('[^a-z]', '') : RT->REC] [VAL = REPL('[^0-9]', '')] ]+"""
    return _named(extract(grids, pattern, ["$a_1", "$a_2"]), "name", "value")


@_query("""select n_regionkey as table_id, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as row, unnest([0, 1])::int as col, unnest([n_nationkey::varchar, n_name]) as text from nation""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = grid_of_rows(_read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])
    return cells(grids).select("table_id", "row", "col", "text")


@_query("""select p_partkey as table_id, 0 as start, length(split_part(p_brand, '#', 1))::int as "end", split_part(p_brand, '#', 1) as s, 0 as idx from part
    union all select p_partkey, length(split_part(p_brand, '#', 1))::int + 1, length(p_brand)::int, split_part(p_brand, '#', 2), 1 from part""")
def item_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of compound cells with the part of the text they come from."""
    grids = grid_of_rows(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey"], ["p_brand"])
    return items(grids, compile_pattern("[ [VAL '#' VAL] ]")).select("table_id", "start", "end", "s", "idx")


@_query("""select o_orderkey as table_id, o_orderkey::varchar as orderkey, o_orderstatus as next, o_orderpriority as second, o_custkey::varchar as before, o_orderstatus || '+' || o_orderpriority as range, o_orderpriority || '+' || o_custkey::varchar as rest from orders""")
def column_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns counted from the anchor's, single and in ranges, and ranges of fixed columns."""
    last = F.col("o_custkey").cast("string")
    orders = _read(spark, sf_dir, "orders").select("*", last.alias("last"), F.lit("r").alias("range"), F.lit("s").alias("rest"))
    grids = grid_of_rows(orders, ["o_orderkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority", "last", "range", "rest"])
    pattern = """[ [VAL : 'KEY'->AVP, (ROW&C+1, ROW&C2, ROW&#'b', ROW&C4, ROW&C5)->REC] [VAL : 'NEXT'->AVP] [VAL : 'SECOND'->AVP] [VAL #'b' : 'BEFORE'->AVP]
        [VAL : (ROW&C1..2)*->FILL('+'), 'RANGE'->AVP] [VAL : (ROW&C-3|ROW&C-2)*->FILL('+'), 'REST'->AVP] ]"""
    return _named(extract(grids, pattern, ["KEY", "NEXT", "SECOND", "BEFORE", "RANGE", "REST"]), "orderkey", "next", "second", "before", "range", "rest")


@_query("""with n as (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as i from nation)
    select a.n_regionkey as table_id, a.n_name as name, coalesce(b.n_name, '') as after, coalesce(c.n_name, '') as ahead, coalesce(string_agg(d.n_name, '+' order by d.i), '') as early
    from n a left join n b on a.n_regionkey = b.n_regionkey and b.i = a.i + 1 left join n c on a.n_regionkey = c.n_regionkey and c.i = a.i - 1
    left join n d on a.n_regionkey = d.n_regionkey and d.i between 0 and 1 and d.i <> a.i group by 1, 2, 3, 4""")
def row_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted from the anchor's, and a range of fixed rows."""
    nations = _read(spark, sf_dir, "nation").select("*", *(F.col("n_name").alias(f"n{i}") for i in range(3)))
    grids = grid_of_rows(nations, ["n_regionkey"], ["n_nationkey"], ["n_name", "n0", "n1", "n2"])
    found = extract(grids, "[ [VAL : RT*->REC] [VAL : (COL&R+1)->FILL] [VAL : (COL&R-1)->FILL] [VAL : (COL&R0..1)*->FILL('+')] ]+", ["$a_1", "$a_2", "$a_3", "$a_4"])
    return _named(found, "name", "after", "ahead", "early")


@_query("""select p_partkey as table_id, split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as second,
    split_part(p_name, ' ', 2) as following, split_part(p_name, ' ', 1) || '+' || split_part(p_name, ' ', 2) as range from part where len(string_split(p_name, ' ')) = 2""")
def item_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a delimited text by their place: fixed, counted from another's, and a range."""
    two = F.size(F.split("p_name", " ")) == 2
    parts = _read(spark, sf_dir, "part").where(two).select("p_partkey", "p_name", *(F.lit("x").alias(f"x{i}") for i in range(2)))
    grids = grid_of_rows(parts, ["p_partkey"], ["p_partkey"], ["p_name", "x0", "x1"])
    pattern = """[ [VAL : 'FIRST'->AVP, (CL&P1, ROW&C1, ROW&C2)->REC ' ' VAL : 'SECOND'->AVP] [VAL : (LT&P1)->FILL, 'FOLLOWING'->AVP] [VAL : (ROW&C0&P0..1)*->FILL('+'), 'RANGE'->AVP] ]"""
    return _named(extract(grids, pattern, ["FIRST", "SECOND", "FOLLOWING", "RANGE"]), "first", "second", "following", "range")


@_query("""select p_partkey as table_id, split_part(p_brand, '#', 1) as make, split_part(p_brand, '#', 2) as number from part""")
def next_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item one place after the anchor."""
    grids = grid_of_rows(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey"], ["p_brand"])
    return _named(extract(grids, "[ [VAL : 'MAKE'->AVP, (CL&P+1)->REC '#' VAL : 'NUMBER'->AVP] ]", ["MAKE", "NUMBER"]), "make", "number")


@_query("""with n as (select r_regionkey, r_name, n_name, n_nationkey, row_number() over (partition by r_regionkey order by n_nationkey) as i from region join nation on n_regionkey = r_regionkey)
    select a.r_regionkey as table_id, a.n_name as nation, a.r_name as beside, b.n_name as below, b.n_name || '+' || b.r_name as others
    from n a join n b on a.r_regionkey = b.r_regionkey and b.i = a.i + 1 where a.i % 2 = 1 and a.i < 5""")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups bound to a subrow, to a column of a subtable, and to a subtable: two nations make a block."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey"))
    nations = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("i", number).where("i <= 4")
    rows = nations.select("r_regionkey", "n_nationkey", "n_name", "r_name", F.lit("x").alias("x"))
    grids = grid_of_rows(rows, ["r_regionkey"], ["n_nationkey"], ["n_name", "r_name", "x"])
    pattern = """{ [ { [VAL : 'NATION'->AVP, (SR, SC, ROW&C2)->REC] [VAL : 'BESIDE'->AVP] } { [VAL : (ST&R+1)*->FILL('+'), 'OTHERS'->AVP] } ] [ { [VAL : 'BELOW'->AVP] [VAL] } { [] } ] }+"""
    return _named(extract(grids, pattern, ["NATION", "BESIDE", "BELOW", "OTHERS"]), "nation", "beside", "below", "others")


@_query("""select s_suppkey as table_id, lower(replace(s_name, '#', ' ')) as name, s_nationkey::varchar as nation from supplier where contains(s_name, '1') and s_nationkey < 10""")
def item_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell that contains a text, an item by a regular expression, and a chain of extractors; NORM tidies the records."""
    grids = grid_of_rows(_read(spark, sf_dir, "supplier").withColumn("copy", F.concat(F.lit("  "), F.col("s_nationkey").cast("string"), F.lit(" "))), ["s_suppkey"], ["s_suppkey"], ["s_name", "copy"])
    found = extract(grids, r"""<NORM> [ [~'1' ? VAL = REPL('#', '  ').LC : (ROW&'\s*\d\s*')->REC | SKIP] [VAL] ]""", ["$a_1", "$a_2"])
    return _named(found.where("`$a_2` is not null"), "name", "nation")


@_query("""select c_custkey as table_id, c_name as name, c_mktsegment as segment, c_custkey::varchar as source from customer""")
def kinds_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider of auxiliary items, and settings that only the Python vocabulary has."""
    grids = grid_of_rows(_read(spark, sf_dir, "customer").withColumn("both", F.concat_ws("/", "c_name", "c_mktsegment")), ["c_custkey"], ["c_custkey"], ["c_custkey", "both"])
    aux = d.ROW.of_kind("AUX")
    pattern = d.table(d.row(d.cell(d.AUX), d.cell(d.val(d.avp("BOTH"), d.rec(aux)))))
    pattern = pattern.with_transformations(d.field_splitting("BOTH", "/", ["NAME", "SEGMENT"]), d.schema_reordering("NAME", "SEGMENT"))
    return _named(extract(grids, pattern, ["BOTH", "$a_2"]), "name", "segment", "source")


@_query("""select case n_regionkey when 0 then null when 3 then 1 else n_regionkey end as table_id, (row_number() over (partition by n_regionkey, way order by n_nationkey) - 1)::int as number,
    n_nationkey::varchar as key, n_name as name, way from nation cross join (select unnest(['arrays', 'rows']) as way)""")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without an id, and two of one id: each has its own records, as arrays and as rows."""
    grids = grid_of_rows(_read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])
    region = F.col("table_id")
    grids = grids.withColumn("table_id", F.when(region == 3, 1).when(region != 0, region))
    made = lambda way, n: extract(grids, "[ [VAL : 'KEY'->AVP, RT->REC] [VAL : 'NAME'->AVP] ]+", ["KEY", "NAME"], local_cells=n).withColumn("way", F.lit(way))
    return made("arrays", 64).union(made("rows", 0)).toDF("table_id", "number", "key", "name", "way")


@_query("""select conv_id as table_id, turn::varchar as turn, coalesce(lag(role) over w || '<', '') || coalesce(lag(role, 2) over w || '<', '') || role as roles,
    coalesce(first_value(role) over w, '') as first from conversations window w as (partition by conv_id order by turn)""")
def few_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest above and the first of a column, as lists carried along it."""
    turns = _read(spark, sf_dir, "conversations").withColumn("first", F.col("role"))
    grids = grid_of_rows(turns, ["conv_id"], ["turn"], ["turn", "role", "first"])
    pattern = """[ [VAL : 'TURN'->AVP, RT*->REC] [VAL : -AV{2}->PREFIX('<'), 'ROLES'->AVP] [VAL : 'FIRST'->AVP] ]
        [ [VAL : 'TURN'->AVP, RT*->REC] [VAL : -AV{2}->PREFIX('<'), 'ROLES'->AVP] [VAL : (COL&R0)->FILL, 'FIRST'->AVP] ]*"""
    return _named(extract(grids, pattern, ["TURN", "ROLES", "FIRST"], local_cells=0), "turn", "roles", "first")


@_query("""with l as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as i from events),
    k as (select user_id, string_agg(event_type, '/' order by i) as kinds from l where i <= 40 group by 1)
    select user_id as table_id, event_id::varchar as event, kinds from l join k using (user_id) where i = 1""")
def all_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of a column for its head: a list for each line, collected once."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("i", number).where("i <= 40")
    grids = grid_of_rows(events, ["user_id"], ["event_id"], ["event_id", "event_type"])
    found = extract(grids, "[ [VAL : 'EVENT'->AVP, RT->REC] [VAL : BW*->SUFFIX('/'), 'KINDS'->AVP] ] [ [] [AUX] ]*", ["EVENT", "KINDS"], local_cells=0)
    return _named(found, "event", "kinds")


@_query("""select 'orders' as table_id, (row_number() over (order by o_orderkey) - 1)::int as number, o_orderkey::varchar as orderkey, o_orderstatus as status, o_orderpriority as priority from orders""")
def tall_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one table, given row by row."""
    rows = _read(spark, sf_dir, "orders").select(F.lit("orders").alias("t"), "o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("cells"))
    pattern = "[ [VAL : 'KEY'->AVP, RT*->REC] [VAL : 'STATUS'->AVP] [VAL : 'PRIORITY'->AVP] ]+"
    return extract_rows(rows, pattern, ["KEY", "STATUS", "PRIORITY"], table_id="t", row="o_orderkey").toDF("table_id", "number", "orderkey", "status", "priority")


@_query("""select o_custkey % 50 as table_id, o_orderkey::varchar as orderkey, o_orderstatus as status, l_partkey::varchar as part from orders join lineitem on l_orderkey = o_orderkey""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of sections, row by row: an order's head, then its lines, each with what its section's head says."""
    from pyspark.sql import Window

    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 50).alias("t"))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_orderkey", "t").orderBy("o_orderstatus", "l_linenumber", "l_partkey")
    numbered = lines.select("*", F.row_number().over(order).alias("n"), F.col("o_orderstatus").eqNullSafe(F.lag("o_orderstatus").over(order)).alias("same"))
    row = lambda number, *texts: F.struct(number.alias("row"), F.array(*texts).alias("cells"))
    text = lambda c: F.col(c).cast("string")
    head = row(F.col("n") * 2 - 1, F.lit("order"), text("o_orderkey"), F.col("o_orderstatus"))
    line = row(F.col("n") * 2, F.lit("line"), text("l_partkey"), F.lit(""))
    own = F.when((F.col("n") > 1) & F.col("same"), F.array(line)).otherwise(F.array(head, line))
    rows = numbered.select("t", F.col("o_orderkey").alias("part"), F.explode(own).alias("r")).select("t", "part", "r.*")
    pattern = """{ [ ['order' ? SKIP] [VAL#'o' : 'ORDER'->AVP] [VAL#'s' : 'STATUS'->AVP] ] [ ['line' ? SKIP] [VAL : 'PART'->AVP, (ST&#'o', ST&#'s')->REC] [BLANK ? SKIP] ]+ }+"""
    found = extract_rows(rows, pattern, ["ORDER", "STATUS", "PART"], table_id="t", part="part", row="row")
    return _named(found, "orderkey", "status", "part")


@_query("""select o_orderkey as table_id, o_orderkey::varchar as orderkey, o_orderstatus || '+' || o_orderpriority as next, o_custkey::varchar as last from orders""")
def relative_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns from one to two after the anchor's."""
    orders = _read(spark, sf_dir, "orders").select("*", F.lit("r").alias("range"), F.col("o_custkey").cast("string").alias("last"))
    grids = grid_of_rows(orders, ["o_orderkey"], ["o_orderkey"], ["o_orderkey", "range", "o_orderstatus", "o_orderpriority", "last"])
    pattern = "[ [VAL : 'KEY'->AVP, (ROW&C1, ROW&C+4..*)->REC] [VAL : (ROW&C+1..2)*->FILL('+'), 'NEXT'->AVP] [VAL] [VAL] [VAL : 'LAST'->AVP] ]"
    return _named(extract(grids, pattern, ["KEY", "NEXT", "LAST"]), "orderkey", "next", "last")


@_query("""select n_regionkey as table_id, n_name as name, coalesce(lead(n_name) over (partition by n_regionkey order by n_nationkey), '') as next from nation""")
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of rows after the anchor's, which is its first row alone."""
    grids = grid_of_rows(_read(spark, sf_dir, "nation").withColumn("copy", F.col("n_name")), ["n_regionkey"], ["n_nationkey"], ["n_name", "copy"])
    return _named(extract(grids, "[ [VAL : RT->REC] [VAL : (COL&R+1..2)*->FILL('+')] ]+", ["$a_1", "$a_2"]), "name", "next")


@_query("""with ok as (select o_custkey from orders group by 1 having bool_and(contains(o_orderpriority, '-U') or contains(o_orderpriority, '-H') or contains(o_orderpriority, '-L')))
    select o_custkey as table_id, split_part(o_orderpriority, '-', 1) as number, split_part(o_orderpriority, '-', 2) as name from orders join ok using (o_custkey)""")
def late_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text without a delimiter fails its whole table, other tables are whole."""
    word = F.regexp_replace("o_orderpriority", "-([UHL])", "=$1")
    grids = grid_of_rows(_read(spark, sf_dir, "orders").withColumn("word", word), ["o_custkey"], ["o_orderkey"], ["word"])
    return _named(extract(grids, "[ [VAL : 'NUMBER'->AVP, CL->REC '=' VAL : 'NAME'->AVP] ]+", ["NUMBER", "NAME"]), "number", "name")


@_query("""select s_suppkey as table_id, reverse(s_name) as name, s_nationkey::varchar as nation from supplier where s_nationkey % 2 = 0""")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test of cells and an extractor that are Python functions."""
    grids = grid_of_rows(_read(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_suppkey"], ["s_name", "s_nationkey"])
    even = Bindings().cell("even", lambda text: text[-1:] in tuple("02468"))
    name = d.val(d.avp("NAME"), d.rec(d.RT)).extract(lambda text: text[::-1])
    own = compile_pattern("[ [VAL] [EXT('even') ? VAL : 'NATION'->AVP] ]", even)
    cell = own.subtables[0].rows[0].subrows[0].cells[1]
    pattern = d.table(d.row(d.cell(name), d.cell(cell.guard, d.val(d.avp("NATION")))))
    return _named(extract(grids, pattern, ["NAME", "NATION"]), "name", "nation")


@_query("select o_orderkey as table_id, o_orderkey::varchar as orderkey, o_orderstatus as status, o_orderpriority as priority from orders")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts of a pattern's text."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    pattern = "$K=[VAL : RT*->REC] $V=[VAL] [ [$K] [$V] [$V] ]"
    return _named(extract(grids, pattern, ["$a_1", "$a_2", "$a_3"]), "orderkey", "status", "priority")


@_query("select n_regionkey as table_id, n_nationkey::varchar as key, n_name as name from nation")
def class_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern put together level by level from classes."""
    grids = grid_of_rows(_read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])
    row = fluent.RowPattern.of(fluent.ONE_OR_MORE, fluent.CellPattern.of(d.val(d.rec(d.RT))), fluent.CellPattern.of(d.VAL))
    return _named(extract(grids, fluent.TablePattern.of(row), ["$a_1", "$a_2"]), "key", "name")


@_query("""select o_orderkey as table_id, case when o_orderstatus <> 'F' then o_orderkey::varchar end as orderkey, case when o_orderstatus <> 'F' then o_orderstatus end as status, o_orderstatus = 'F' as wrong from orders""")
def wrong_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an attribute twice are told of in a field, the others are whole."""
    grids = grid_of_rows(_read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    found = extract(grids, "[ [VAL : 'KEY'->AVP, RT->REC] ['F' ? VAL : 'KEY'->AVP | VAL : 'STATUS'->AVP] ]", ["KEY", "STATUS"], options=Options(on_error="null"))
    return found.select("table_id", F.col("KEY").alias("orderkey"), F.col("STATUS").alias("status"), F.col("_error").isNotNull().alias("wrong"))


@_query("""select p_partkey as table_id, split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as second, p_type as type from part""")
def declared_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPLIT with declared widths: no look at the data before the result is used."""
    grids = grid_of_rows(_read(spark, sf_dir, "part").withColumn("type", F.replace("p_type", F.lit(" "), F.lit("_"))), ["p_partkey"], ["p_partkey"], ["p_name", "type"])
    found = extract(grids, "<SPLIT(' ')> [ [VAL : 'NAME'->AVP, RT->REC] [VAL : 'TYPE'->AVP] ]", ["NAME", "TYPE"], widths={"NAME": 2})
    return _named(found.withColumn("$a_3", F.replace("`$a_3`", F.lit("_"), F.lit(" "))), "first", "second", "type")


@_query("""select o_custkey as table_id, o_orderkey::varchar as orderkey, o_orderstatus as status from orders where o_orderpriority = '1-URGENT'""")
def formatted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a font: urgent orders' keys are bold, and only rows that begin with a bold cell give records."""
    cell = lambda text, bold: F.struct(F.col(text).cast("string").alias("text"), bold.alias("bold"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = dealt(_read(spark, sf_dir, "orders"), "o_custkey").select("o_custkey", F.struct("o_orderkey", F.array(cell("o_orderkey", urgent), cell("o_orderstatus", F.lit(False))).alias("cells")).alias("row"))
    grids = rows.groupBy(F.col("o_custkey").alias("table_id")).agg(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["cells"]).alias("grid"))
    bold = Bindings().cell("bold", lambda c: c["bold"], whole=True)
    found = extract(grids, "[ [EXT('bold') ? VAL : 'KEY'->AVP, RT->REC | SKIP] [VAL : 'STATUS'->AVP] ]+", ["KEY", "STATUS"], bindings=bold)
    return _named(found, "orderkey", "status")


@_query("select r_regionkey as table_id, r_name as region, n_name as nation from region join nation on n_regionkey = r_regionkey")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's name stands once, in a cell merged over the rows of its nations."""
    nations = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    grids = grid_of_rows(nations, ["r_regionkey"], ["n_nationkey"], ["r_name", "n_name"])
    once = F.transform("grid", lambda row, i: F.when(i == 0, row).otherwise(F.array(F.lit(""), row[1])))
    region = F.array(F.struct(F.lit(0).alias("top"), F.lit(0).alias("left"), (F.size("grid") - 1).alias("bottom"), F.lit(0).alias("right")))
    filled = grids.withColumn("regions", region).withColumn("grid", once).withColumn("grid", fill_merged(F.col("grid"), F.col("regions")))
    return _named(extract(filled, "[ [VAL : 'REGION'->AVP, RT->REC] [VAL : 'NATION'->AVP] ]+", ["REGION", "NATION"]), "region", "nation")
