"""A query for each operator of the engine over the driver's tables, beside the SQL that DuckDB answers it with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.table import ROW_SEQ, LazyTable, desc

_QUERIES: dict[str, tuple[Callable[[Callable[[str], LazyTable]], LazyTable], str]] = {}


def _query(sql: str):
    def add(build):
        _QUERIES[build.__name__] = (build, sql)
        return build

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda name: LazyTable.from_df(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)).to_df()

        return run

    return {name: runner(build) for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}


@_query("""SELECT o_custkey, sum(o_totalprice * 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10""")
def flagship_top_customers(t):
    x = t("orders").with_env(status="F").filter("o_orderstatus == status").mutate(double_amount="o_totalprice * 2")
    return x.group_by("o_custkey").summarise(total="sum(double_amount)", n="n()").arrange(desc("total"), "o_custkey").slice_head(10)


# -- filter ---------------------------------------------------------------------


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O' AND o_totalprice <= 3000")
def filter_multi(t):
    return t("orders").filter("o_totalprice > 1000", "o_orderstatus == 'O'").filter("o_totalprice <= 3000").select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR NOT (o_totalprice >= 2000)")
def filter_or_not(t):
    return t("orders").filter("(o_orderstatus == 'P') | ~(o_totalprice >= 2000)").select("o_orderkey")


@_query("SELECT o_orderkey, o_orderpriority FROM orders WHERE coalesce(o_orderstatus IN ('F', 'P'), false) AND o_orderkey <> 7")
def filter_in(t):
    return t("orders").with_env(wanted=["F", "P"]).filter("o_orderstatus in wanted", "o_orderkey != 7").select("o_orderkey", "o_orderpriority")


@_query("SELECT vec_id FROM embeddings WHERE NOT coalesce(list_contains(embedding, embedding[2] + 0), false) OR vec_id % 2 = 0")
def filter_in_array(t):
    first = t("embeddings").mutate(second=F.element_at("embedding", 2))
    return first.filter("~(second in embedding) | (vec_id % 2 == 0)").select("vec_id")


@_query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events) WHERE v IS NULL")
def filter_is_na(t):
    return t("events").mutate(v="case_when((value > 50, value))").filter("is_na(v)").select("event_id", "v")


@_query("SELECT event_id FROM (SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events) WHERE v < 80")
def filter_null_drops(t):
    return t("events").mutate(v="case_when((value > 50, value))").filter("v < 80").select("event_id")


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-06-01 00:00:00'")
def filter_timestamp(t):
    x = t("orders").with_env(low=dt.datetime(1996, 1, 1), high=dt.datetime(1997, 6, 1, tzinfo=dt.timezone.utc))
    return x.filter("o_orderdate >= low", "o_orderdate < high").select("o_orderkey", "o_orderdate")


# -- projections ----------------------------------------------------------------


@_query("SELECT c_custkey AS id, c_name AS name FROM customer")
def select_rename(t):
    return t("customer").select(id="c_custkey", name="c_name")


@_query("SELECT c_name, c_custkey FROM customer")
def select_order(t):
    return t("customer").select("c_name", "c_custkey")


@_query("SELECT c_custkey AS custkey, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def rename_keep_order(t):
    return t("customer").rename(balance="c_acctbal", custkey="c_custkey")


@_query("SELECT c_acctbal * 2 AS twice, c_acctbal * 2 + 1 AS more FROM customer")
def transmute_chain(t):
    return t("customer").transmute(twice="c_acctbal * 2", more="twice + 1")


# -- mutate and arithmetic -----------------------------------------------------------


@_query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def mutate_dependent(t):
    return t("lineitem").mutate(net="l_extendedprice * (1 - l_discount)", charge="net * (1 + l_tax)").select("l_orderkey", "net", "charge")


@_query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 100 AS s_acctbal FROM supplier")
def mutate_overwrite(t):
    return t("supplier").mutate(s_acctbal="s_acctbal + 100")


@_query("SELECT l_orderkey, l_quantity + l_tax AS a, l_quantity - l_tax AS b, -1 * l_quantity AS c, l_extendedprice / l_quantity AS d FROM lineitem WHERE l_quantity > 0")
def mutate_arith(t):
    return t("lineitem").filter("l_quantity > 0").mutate(a="l_quantity + l_tax", b="l_quantity - l_tax", c="-l_quantity", d="l_extendedprice / l_quantity").select("l_orderkey", "a", "b", "c", "d")


@_query("SELECT p_partkey, p_partkey % 7 AS m, (3 - p_partkey) % 7 AS neg, pow(p_size, 2) AS p FROM part")
def mutate_mod_pow(t):
    return t("part").mutate(m="p_partkey % 7", neg="(3 - p_partkey) % 7", p="p_size ** 2").select("p_partkey", "m", "neg", "p")


@_query("SELECT p_partkey, round_even(p_retailprice, 1) AS r1, round_even(p_size / 2, 0) AS r0 FROM part")
def math_round(t):
    return t("part").mutate(r1="round(p_retailprice, 1)", r0="round(p_size / 2)").select("p_partkey", "r1", "r0")


@_query("SELECT p_partkey, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, trunc(p_retailprice) AS t, abs(10.0::DOUBLE - p_size) AS a FROM part")
def math_floor_ceil_trunc(t):
    return t("part").mutate(f="floor(p_retailprice)", c="ceiling(p_retailprice)", t="trunc(p_retailprice)", a="abs(10.0 - p_size)").select("p_partkey", "f", "c", "t", "a")


@_query("""SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(ln(p_retailprice) / ln(2), 9) AS l2,
round(exp(p_size / 50.0), 9) AS e, sqrt(p_size) AS s FROM part""")
def math_log_exp(t):
    x = t("part").mutate(l="log(p_retailprice)", l10="log10(p_retailprice)", l2="log(p_retailprice, 2)", e="exp(p_size / 50.0)", s="sqrt(p_size)")
    return x.mutate(**{c: F.round(c, 9) for c in ("l", "l10", "l2", "e")}).select("p_partkey", "l", "l10", "l2", "e", "s")


@_query("SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size / 60.0), 9) AS c FROM part")
def math_trig(t):
    x = t("part").mutate(a="sin(p_size)", b="cos(p_size)", c="tan(p_size / 60.0)")
    return x.mutate(**{c: F.round(c, 9) for c in "abc"}).select("p_partkey", "a", "b", "c")


@_query("SELECT p_partkey, round(asin(p_size / 60.0), 9) AS a, round(acos(p_size / 60.0), 9) AS b, round(atan(p_size), 9) AS c, round(atan2(p_size, 3), 9) AS d FROM part")
def math_inverse_trig(t):
    x = t("part").mutate(a="asin(p_size / 60.0)", b="acos(p_size / 60.0)", c="atan(p_size)", d="atan2(p_size, 3)")
    return x.mutate(**{c: F.round(c, 9) for c in "abcd"}).select("p_partkey", "a", "b", "c", "d")


@_query("SELECT p_partkey, round(sinh(p_size / 50.0), 8) AS a, round(cosh(p_size / 50.0), 8) AS b, round(tanh(p_size / 50.0), 8) AS c FROM part")
def math_hyper(t):
    x = t("part").mutate(a="sinh(p_size / 50.0)", b="cosh(p_size / 50.0)", c="tanh(p_size / 50.0)")
    return x.mutate(**{c: F.round(c, 8) for c in "abc"}).select("p_partkey", "a", "b", "c")


@_query("SELECT p_partkey, round(asinh(p_size), 8) AS a, round(acosh(p_size + 1), 8) AS b, round(atanh(p_size / 60.0), 8) AS c FROM part")
def math_inverse_hyper(t):
    x = t("part").mutate(a="asinh(p_size)", b="acosh(p_size + 1)", c="atanh(p_size / 60.0)")
    return x.mutate(**{c: F.round(c, 8) for c in "abc"}).select("p_partkey", "a", "b", "c")


@_query("SELECT l_orderkey, least(l_quantity, l_tax * 100) AS low, greatest(l_quantity, l_tax * 100, 10) AS high FROM lineitem")
def pmin_pmax(t):
    return t("lineitem").mutate(low="pmin(l_quantity, l_tax * 100)", high="pmax(l_quantity, l_tax * 100, 10)").select("l_orderkey", "low", "high")


# -- strings and conditions --------------------------------------------------------


@_query("SELECT doc_id, length(text) AS n, lower(lang) AS a, upper(source) AS b FROM documents")
def str_case_nchar(t):
    return t("documents").mutate(n="nchar(text)", a="tolower(lang)", b="toupper(source)").select("doc_id", "n", "a", "b")


@_query("SELECT c_custkey, c_name || ' ' || c_mktsegment AS a, c_name || '-' || c_mktsegment || '-x' AS b, c_name || c_mktsegment AS c FROM customer")
def str_paste(t):
    return t("customer").mutate(a="paste(c_name, c_mktsegment)", b="paste(c_name, c_mktsegment, 'x', sep='-')", c="paste0(c_name, c_mktsegment)").select("c_custkey", "a", "b", "c")


@_query("SELECT c_custkey, c_name || '-' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS a FROM customer")
def str_paste_number(t):
    return t("customer").mutate(a="paste(c_name, c_nationkey, floor(c_acctbal), sep='-')").select("c_custkey", "a")


@_query("SELECT doc_id, substr(text, 3, 6) AS a, substr(text, 1, 4) AS b FROM documents")
def str_substr(t):
    return t("documents").mutate(a="substr(text, 3, 8)", b="substring(text, 0, 4)").select("doc_id", "a", "b")


@_query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'big' ELSE 'small' END AS size FROM orders")
def if_else(t):
    return t("orders").mutate(size="if_else(o_totalprice > 1000, 'big', 'small')").select("o_orderkey", "size")


@_query("SELECT o_orderkey, CASE WHEN o_totalprice > 3000 THEN 'a' WHEN o_totalprice > 1000 THEN 'b' ELSE 'c' END AS k FROM orders")
def case_when(t):
    return t("orders").mutate(k="case_when((True, 'c'), (o_totalprice > 3000, 'a'), (o_totalprice > 1000, 'b'))").select("o_orderkey", "k")


@_query("SELECT o_orderkey, CASE WHEN o_totalprice > 3000 THEN 1 END AS k FROM orders")
def case_when_no_default(t):
    return t("orders").mutate(k="case_when((o_totalprice > 3000, 1))").mutate(k=F.col("k").cast("int")).select("o_orderkey", "k")


# -- groups ------------------------------------------------------------------------


@_query("SELECT count(*) AS n, coalesce(sum(l_quantity), 0) AS q, avg(l_discount) AS d, min(l_shipdate) AS low, max(l_shipdate) AS high FROM lineitem")
def summarise_global(t):
    return t("lineitem").summarise(n="n()", q="sum(l_quantity)", d="mean(l_discount)", low="min(l_shipdate)", high="max(l_shipdate)")


@_query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
def summarise_grouped(t):
    return t("lineitem").group_by("l_returnflag").summarise(n="n()", q="sum(l_quantity, na_rm=True)")


@_query("SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS p, max(l_linenumber) AS m FROM lineitem GROUP BY ALL")
def summarise_multi_key(t):
    return t("lineitem").group_by("l_returnflag").group_by("l_linestatus", add=True).summarise(p="mean(l_extendedprice)", m="max(l_linenumber)")


@_query("SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS net, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ALL")
def summarise_expr_arg(t):
    return t("lineitem").group_by("l_returnflag").summarise(net="sum(l_extendedprice * (1 - l_discount))", lines="sum(l_linenumber)")


@_query("SELECT event_type, coalesce(sum(CASE WHEN value > 1e12 THEN value END), 0) AS s, avg(CASE WHEN value > 1e12 THEN value END) AS m FROM events GROUP BY event_type")
def summarise_sum_all_null(t):
    return t("events").mutate(v="case_when((value > 1e12, value))").group_by("event_type").summarise(s="sum(v)", m="mean(v)")


@_query("SELECT o_orderstatus, max(n) AS most FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL")
def summarise_twice(t):
    return t("orders").group_by("o_orderstatus", "o_custkey").summarise(n="n()").group_by("o_orderstatus").summarise(most="max(n)")


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_filter(t):
    return t("orders").group_by("o_custkey").summarise(n="n()").filter("n > 12")


# -- order, slices, row numbers ------------------------------------------------------


@_query("""SELECT event_id, v FROM (SELECT event_id, CASE WHEN value > 90 THEN value END AS v FROM events) ORDER BY v NULLS FIRST, event_id LIMIT 25""")
def arrange_nulls_topk(t):
    return t("events").mutate(v="case_when((value > 90, value))").arrange("v", "event_id").slice_head(25).select("event_id", "v")


@_query("SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def arrange_by_group(t):
    return t("orders").group_by("o_orderstatus").arrange(desc("o_totalprice"), "o_orderkey", by_group=True).select("o_orderstatus", "o_orderkey")


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def slice_tail(t):
    return t("orders").arrange("o_orderkey").slice_tail(7).select("o_orderkey")


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) - 30 FROM orders)")
def slice_head_neg(t):
    return t("orders").arrange("o_orderkey").slice_head(-30).select("o_orderkey")


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 30")
def slice_tail_neg(t):
    return t("orders").arrange("o_orderkey").slice_tail(-30).select("o_orderkey")


@_query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 6) ORDER BY o_orderkey DESC LIMIT 2")
def slice_compose(t):
    return t("orders").arrange("o_orderkey").slice_head(6).slice_tail(2).select("o_orderkey")


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 6")
def head_default(t):
    return t("orders").arrange("o_orderkey").head().select("o_orderkey")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders")
def row_seq(t):
    return t("orders").arrange("o_orderkey").mutate(i=ROW_SEQ).select("o_orderkey", "i")


@_query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders")
def row_seq_grouped(t):
    return t("orders").arrange("o_orderkey").group_by("o_custkey").mutate(i=ROW_SEQ).select("o_orderkey", "o_custkey", "i")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'P'")
def row_seq_after_desc(t):
    return t("orders").arrange(desc("o_totalprice"), "o_orderkey").filter("o_orderstatus == 'P'").mutate(o_totalprice="0.0", i=ROW_SEQ).select("o_orderkey", "i")


# -- nested documents ------------------------------------------------------------------


def _packed(t):
    x = t("customer")
    df = x.df.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")).alias("account")).alias("person"))
    return LazyTable.from_df(df, "packed")


@_query('SELECT c_custkey, c_name AS "person.name", c_acctbal AS "person.account.balance", c_nationkey AS "person.account.nation" FROM customer')
def flatten_struct(t):
    return _packed(t).flatten_fields()


@_query("SELECT c_custkey, c_acctbal AS person_account_balance, c_nationkey AS person_account_nation, c_name AS person_name FROM customer WHERE c_acctbal > 0")
def flatten_names_fn(t):
    x = _packed(t).flatten_fields(names_fn=lambda names: [n.replace(".", "_") for n in names])
    return x.filter("person_account_balance > 0")


@_query("SELECT c_custkey, c_acctbal AS b FROM customer WHERE c_acctbal > 100")
def select_nested(t):
    x = _packed(t).filter("person.account.balance > 100").select("c_custkey", "person.account.balance")
    return x.mutate(b="person.account.balance").select("c_custkey", "b")


@_query('SELECT c_custkey, c_nationkey AS "person.account.nation" FROM customer')
def select_nested_flat(t):
    return _packed(t).select("person.account.nation", c_custkey="c_custkey")


@_query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL")
def group_nested_key(t):
    return _packed(t).group_by("person.account.nation").summarise(n="n()").rename(nation="person.account.nation")


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def flatten_json_props(t):
    x = t("events")
    return LazyTable.from_df(x.df.select("event_id", F.from_json("props", "k bigint").alias("props"))).infer_schema().flatten_fields()


@_query("SELECT vec_id, label, CAST(e AS DOUBLE) AS e FROM (SELECT vec_id, label, unnest(embedding) AS e FROM embeddings)")
def unwind_embedding(t):
    return t("embeddings").unwind_array("embedding").mutate(e=F.col("embedding").cast("double")).select("vec_id", "label", "e")


@_query("SELECT label, count(*) AS n FROM (SELECT label, unnest(embedding) AS e FROM embeddings) WHERE e > 0 GROUP BY label")
def unwind_filter_summarise(t):
    return t("embeddings").unwind_array("embedding").filter("embedding > 0").group_by("label").summarise(n="n()")


@_query("""SELECT vec_id, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE label % 2 = 0
UNION ALL SELECT vec_id, NULL FROM embeddings WHERE label % 2 <> 0)""")
def unwind_preserve_empty(t):
    x = t("embeddings").mutate(x=F.when(F.col("label") % 2 == 0, F.col("embedding")).otherwise(F.array().cast("array<float>")))
    return x.unwind_array("x", preserve_empty=True).mutate(x=F.col("x").cast("double")).select("vec_id", "x")


@_query("SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def unwind_nested_path(t):
    df = t("embeddings").df.select("vec_id", F.struct(F.col("embedding").alias("v"), F.col("label").alias("l")).alias("a"))
    return LazyTable.from_df(df).unwind_array("a.v").mutate(x=F.col("a.v").cast("double")).select("vec_id", "x")


@_query("SELECT vec_id, code AS \"items.code\", CAST(v AS DOUBLE) AS \"items.v\" FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 'a' ELSE 'b' END)) AS code, unnest(embedding) AS v FROM embeddings)")
def unwind_then_flatten(t):
    items = F.transform("embedding", lambda x: F.struct(F.when(x > 0, "a").otherwise("b").alias("code"), x.cast("double").alias("v")))
    return LazyTable.from_df(t("embeddings").df.select("vec_id", items.alias("items"))).unwind_array("items").flatten_fields("items")


# -- raw stages -----------------------------------------------------------------------


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5")
def append_stage_limit(t):
    return t("orders").append_stage('{"$limit": 5}').filter("o_orderstatus == 'F'").arrange("o_orderkey").select("o_orderkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 500")
def append_stage_match(t):
    return t("orders").select(o_orderkey="o_orderkey", o_totalprice="o_totalprice", status="o_orderstatus").append_stage('{"$match": {"status": "P", "o_totalprice": {"$gte": 500}}}').append_stage('{"$unset": "status"}')


@_query("SELECT o_orderstatus AS _id, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ALL")
def append_stage_group(t):
    return t("orders").append_stage('{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}')


@_query("SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 9 OFFSET 3")
def append_stage_chain(t):
    x = t("orders")
    for stage in ('{"$match": {"$expr": {"$gt": ["$o_totalprice", 1000]}}}', '{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}', '{"$skip": 3}', '{"$limit": 9}', '{"$addFields": {"twice": {"$multiply": ["$o_totalprice", 2]}}}', '{"$project": {"k": "$o_orderkey", "twice": 1}}'):
        x = x.append_stage(stage)
    return x


@_query("SELECT vec_id, CAST(e AS DOUBLE) AS e, i FROM (SELECT vec_id, unnest(embedding) AS e, CAST(unnest(range(len(embedding))) AS BIGINT) AS i FROM embeddings)")
def append_stage_unwind(t):
    df = t("embeddings").df.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return LazyTable.from_df(df).append_stage('{"$unwind": {"path": "$e", "includeArrayIndex": "i"}}')


@_query("SELECT count(*) AS orders FROM orders")
def append_stage_count(t):
    return t("orders").append_stage('{"$count": "orders"}')


@_query("SELECT c_name AS name, c_acctbal AS balance FROM customer")
def append_stage_replace_root(t):
    x = LazyTable.from_df(t("customer").df.select(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("p")))
    return x.append_stage('{"$replaceRoot": {"newRoot": "$p"}}')


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus <> 'F'")
def append_stage_match_ne(t):
    x = LazyTable.from_df(t("orders").df.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s")))
    return x.append_stage('{"$match": {"s": {"$ne": "F"}}}')


@_query("SELECT doc_id FROM documents WHERE list_contains(string_split(lang || '-' || source, '-'), 'de') OR NOT list_contains(string_split(lang || '-' || source, '-'), 'en')")
def append_stage_match_array(t):
    x = LazyTable.from_df(t("documents").df.select("doc_id", F.split(F.concat("lang", F.lit("-"), "source"), "-").alias("tags")))
    return x.append_stage('{"$match": {"$or": [{"tags": "de"}, {"tags": {"$ne": "en"}}]}}').append_stage('{"$unset": "tags"}')


@_query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def append_stage_nested_field(t):
    x = _packed(t).append_stage('{"$addFields": {"person.account.twice": {"$multiply": ["$person.account.balance", 2]}}}')
    return x.append_stage('{"$project": {"c_custkey": 1, "twice": "$person.account.twice"}}')


# -- what the rows above leave out -----------------------------------------------------


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R')")
def filter_le_and_c(t):
    return t("lineitem").filter("(l_quantity <= 10) & (l_discount >= 0.05) & (l_returnflag in c('A', 'R'))", preserve=True).select("l_orderkey", "l_linenumber")


@_query("SELECT vec_id, embedding AS \"v.parts\", label AS \"v.label\" FROM embeddings")
def flatten_array_leaf(t):
    return LazyTable.from_df(t("embeddings").df.select("vec_id", F.struct(F.col("embedding").alias("parts"), F.col("label").alias("label")).alias("v"))).flatten_fields()


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 2000 AND o_orderkey > 100")
def names_field_before_local(t):
    return t("orders").with_env(o_totalprice=-1.0, low=100).filter("o_totalprice > 2000", "data.o_orderkey > env.low").select("o_orderkey")


@_query("""SELECT p_partkey, CAST(least(p_size, 10) AS VARCHAR) || ' ' || CASE WHEN greatest(p_size, p_retailprice) % 1 = 0
THEN CAST(CAST(greatest(p_size, p_retailprice) AS BIGINT) AS VARCHAR) ELSE 'x' END AS a FROM part""")
def pmin_pmax_as_text(t):
    x = t("part").mutate(high="pmax(p_size, p_retailprice)").mutate(whole="paste(pmin(p_size, 10.0))")
    return x.mutate(a="paste(whole, if_else(high % 1 == 0, paste(pmax(p_size, p_retailprice)), 'x'))").select("p_partkey", "a")


@_query('SELECT c_custkey, c_acctbal AS balance, c_acctbal + 1 AS more FROM customer')
def mutate_nested_field(t):
    x = _packed(t).mutate(**{"person.account.more": "person.account.balance + 1"})
    return x.select(c_custkey="c_custkey", balance="person.account.balance", more="person.account.more")
