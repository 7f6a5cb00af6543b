"""Every relational operator on a projection of the tables, beside its DuckDB SQL.

The projections are ours; what the operators compute is what they compute on parsed programs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edges, flow, layout, lexing, manifest, records, resolve
from ..sources.tables import materialize, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _joined(col: str, sep: str = ","):
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), sep)


# ---------------------------------------------------------------- lines and tokens

_LINES = r"""
lines AS (SELECT doc_id, generate_subscripts(p, 1)::INT AS line, unnest(p) AS raw FROM (
  SELECT doc_id, CASE WHEN q[-1] = '' THEN q[:-2] ELSE q END AS p FROM (
    SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS q FROM documents WHERE text IS NOT NULL))),
code AS (SELECT doc_id, line, raw, regexp_replace(substring(raw, 1, 72), '\s+$', '') AS code FROM lines WHERE raw NOT LIKE '*%'
  AND trim(regexp_replace(substring(raw, 1, 72), '\s+$', '')) <> '')
"""
_TOKEN = r"[XPBCZxpbcz]?''[^'']*(?:''''[^'']*)*''?|[<>]=|[=()+*/<>]|[^\s,=()+*/<>'']+"
_TOKENS = _LINES + rf""",
toks AS (SELECT doc_id, line, generate_subscripts(t, 1)::INT - 1 AS pos, unnest(t) AS raw_token FROM (SELECT doc_id, line, regexp_extract_all(code, '{_TOKEN}') AS t FROM code)),
tokens AS (SELECT doc_id, line, pos, CASE WHEN (length(raw_token) - length(replace(raw_token, '''', ''))) % 2 = 1 THEN raw_token || '''' ELSE raw_token END AS token FROM toks)
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lexing.physical_lines(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return lexing.line_tokens(lexing.code_lines(_lines(spark, d)))


@query("WITH" + _LINES + "SELECT doc_id, line, code FROM code")
def lex_lines(spark, d):
    return lexing.code_lines(_lines(spark, d)).select("doc_id", "line", "code")


@query("WITH" + _LINES + r"""SELECT doc_id, line, substring(tail, 1, 30) AS tail FROM (SELECT doc_id, line, trim(substring(raw, 73)) AS tail FROM lines WHERE raw NOT LIKE '*%')
WHERE tail <> '' AND NOT regexp_matches(tail, '^[A-Za-z0-9]{1,8}$')""")
def lex_tail_flag(spark, d):
    return lexing.lost_tails(_lines(spark, d)).select("doc_id", "line", "tail")


@query("WITH" + _TOKENS + "SELECT doc_id, line, pos, token FROM tokens")
def lex_tokens(spark, d):
    return _tokens(spark, d).select("doc_id", "line", "pos", "token")


@query("WITH" + _TOKENS + r"""SELECT class, count(*)::BIGINT AS n, count(DISTINCT token)::BIGINT AS n_distinct FROM (SELECT token, CASE WHEN regexp_matches(token, '^[XPBCZxpbcz]?''.*''$') THEN 'literal'
WHEN regexp_matches(token, '^[+-]?[0-9]+(\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(token, '^[A-Za-z@#$][A-Za-z0-9@#$_-]*(:[A-Za-z@#$][A-Za-z0-9@#$_-]*)?$') THEN 'name' ELSE 'other' END AS class
FROM tokens) GROUP BY class""")
def token_class(spark, d):
    return _tokens(spark, d).groupBy(T.token_class(F.col("token")).alias("class")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"))


@query("WITH" + _TOKENS + r"""SELECT token, CASE WHEN regexp_matches(token, '^[XPBCZxpbcz]?''.*''$') THEN replace(regexp_extract(token, '^[XPBCZxpbcz]?''(.*)''$', 1), '''''', '''') ELSE token END AS value,
CASE WHEN contains(token, ':') THEN upper(split_part(token, ':', 1)) END AS owner, count(*)::BIGINT AS n FROM tokens GROUP BY 1, 2, 3""")
def literal_values(spark, d):
    t = F.col("token")
    return _tokens(spark, d).groupBy("token", T.literal_value(t).alias("value"), T.owner_part(t).alias("owner")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 > 0 THEN p_type END AS owner, CASE WHEN p_size % 5 > 0 THEN p_size END AS start, p_partkey % 30 + 1 AS length, substr('ANPUBKMX', p_size % 8 + 1, 1) AS fmt FROM part)
SELECT p_partkey, p_brand AS field, owner AS file, CASE WHEN owner IS NULL THEN 'W' END AS storage, start || '-' || (start + length - 1) AS bytes, fmt AS format,
CASE fmt WHEN 'A' THEN 'alphanumeric' WHEN 'N' THEN 'zoned decimal' WHEN 'P' THEN 'packed decimal' WHEN 'U' THEN 'unsigned packed' WHEN 'B' THEN 'binary' WHEN 'K' THEN 'double-byte' WHEN 'M' THEN 'mixed' END AS meaning FROM f""")
def field_descriptor(spark, d):
    size, c = F.col("p_size"), F.col
    f = read_table(spark, d, "part").select(
        "p_partkey", "p_brand", F.when(size % 3 > 0, c("p_type")).alias("owner"), F.when(size % 5 > 0, size).alias("start"), (c("p_partkey") % 30 + 1).alias("length"), F.expr("substr('ANPUBKMX', p_size % 8 + 1, 1)").alias("fmt")
    )
    stop = c("start") + c("length") - 1
    one = T.field_descriptor(c("p_brand"), c("owner"), F.lit("W"), c("start"), stop, c("length"), c("fmt"), F.lit(None).cast("int"))
    return f.select("p_partkey", one.alias("x")).select("p_partkey", "x.field", "x.file", "x.storage", "x.bytes", "x.format", "x.meaning")


@query(r"""WITH c AS (SELECT p_partkey, string_split(p_brand || ' ' || CASE p_size % 4 WHEN 0 THEN '*' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN split_part(p_type, ' ', 1) ELSE '(' || p_size END || ' ' || CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE (p_partkey % 90)::VARCHAR END || ' N', ' ') AS t FROM part)
SELECT p_partkey, t[1] AS name FROM c WHERE regexp_matches(t[1], '^[A-Za-z@#$][A-Za-z0-9@#$_-]*(:[A-Za-z@#$][A-Za-z0-9@#$_-]*)?$') AND regexp_matches(t[3], '^[+-]?[0-9]+(\.[0-9]+)?$')
AND (t[2] = '*' OR regexp_matches(t[2], '^[+-]?[0-9]+(\.[0-9]+)?$') OR regexp_matches(t[2], '^[A-Za-z@#$][A-Za-z0-9@#$_-]*(:[A-Za-z@#$][A-Za-z0-9@#$_-]*)?$'))""")
def declaration_shape(spark, d):
    size = F.col("p_size").cast("string")
    place = F.when(F.col("p_size") % 4 == 0, "*").when(F.col("p_size") % 4 == 1, size).when(F.col("p_size") % 4 == 2, F.substring_index("p_type", " ", 1)).otherwise(F.concat(F.lit("("), size))
    length = F.when(F.col("p_partkey") % 5 == 0, "A").otherwise((F.col("p_partkey") % 90).cast("string"))
    lines = read_table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", place, length, F.lit("N")).alias("code"))
    return lines.where(T.is_field_declaration(T.tokens(F.col("code")))).select("p_partkey", F.get(T.tokens(F.col("code")), F.lit(0)).alias("name"))


@query("WITH" + _LINES + r""", m AS (SELECT *, regexp_matches(code, '[-+]$') AND (length(code) - length(replace(code, '''', ''))) % 2 = 0 AND length(trim(code)) > 1 AS goes FROM code),
s AS (SELECT *, CASE WHEN lag(goes, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY line) THEN 0 ELSE 1 END AS starts FROM m),
i AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM s)
SELECT doc_id, min(line) AS line, trim(string_agg(CASE WHEN goes THEN rtrim(trim(code)[:-2]) || CASE WHEN code LIKE '%+' THEN ' ' ELSE '' END ELSE trim(code) END, '' ORDER BY line)) AS text FROM i GROUP BY doc_id, island""")
def continuation_join(spark, d):
    return lexing.joined_continuations(lexing.code_lines(_lines(spark, d)), "doc_id")


_SIGNALS_SQL = " ".join(f"WHEN regexp_matches(trim(raw), '{p}') THEN 'signal'" for p in lexing.LANGUAGE_SIGNALS)


@query("WITH" + _LINES + rf""", k AS (SELECT doc_id, line, CASE WHEN regexp_matches(trim(raw), '{lexing.JOB_CONTROL}') THEN 'job control' WHEN regexp_matches(trim(raw), '{lexing.OTHER_LANGUAGE}') THEN 'other language'
{_SIGNALS_SQL} END AS kind FROM lines WHERE raw NOT LIKE '*%' AND trim(raw) <> ''),
n AS (SELECT *, sum(CASE WHEN kind = 'signal' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM k WHERE kind IS NOT NULL),
f AS (SELECT doc_id, min(line) FILTER (n >= 2) AS second, min(line) FILTER (kind <> 'signal') AS other_line, arg_min(kind, line) FILTER (kind <> 'signal') AS other FROM n GROUP BY doc_id)
SELECT doc_id, coalesce(second IS NOT NULL AND (other_line IS NULL OR other_line > second), FALSE) AS is_program,
CASE WHEN second IS NOT NULL AND (other_line IS NULL OR other_line > second) THEN 'statements' WHEN other IS NOT NULL AND (second IS NULL OR other_line < second) THEN other ELSE 'nothing found' END AS why
FROM (SELECT DISTINCT doc_id FROM lines) LEFT JOIN f USING (doc_id)""")
def detect_lang(spark, d):
    return lexing.detected_languages(_lines(spark, d), "doc_id")


@query(r"""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, upper(w[i]) AS k, w[i + 1] AS t FROM w, unnest(range(1, len(w) + 1)) AS r(i))
SELECT doc_id, string_agg(DISTINCT upper(t), ',' ORDER BY upper(t)) AS tables FROM p
WHERE k IN ('FROM', 'INTO', 'UPDATE', 'JOIN') AND t NOT LIKE ':%' AND regexp_matches(t, '^[A-Za-z@#$_][A-Za-z0-9@#$_]*(\.[A-Za-z@#$_][A-Za-z0-9@#$_]*)*$') GROUP BY doc_id""")
def sql_tables(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null")
    found = T.sql_tables(F.split(F.regexp_replace(F.col("text"), r"^\s+|\s+$", ""), r"\s+"))
    return docs.select("doc_id", F.array_join(found, ",").alias("tables")).where("tables <> ''")


@query(r"""SELECT page_id, CASE WHEN stem = '' THEN 'PROGRAM' ELSE upper(stem) END AS program FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1), '\.[^.]*$', ''), '\.[^.]*$', '') AS stem FROM pages)""")
def name_split(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.program_name(F.col("url")).alias("program"))


@query("WITH" + _TOKENS + rf"""SELECT upper(token) AS word, count(*)::BIGINT AS n FROM tokens WHERE regexp_matches(token, '^[A-Za-z@#$][A-Za-z0-9@#$_-]*(:[A-Za-z@#$][A-Za-z0-9@#$_-]*)?$') AND upper(token) NOT IN ({", ".join(f"'{w}'" for w in T.NOISE_WORDS)}) GROUP BY 1""")
def noise_filter(spark, d):
    noise = spark.createDataFrame([(w,) for w in T.NOISE_WORDS], "word string")
    return lexing.without_noise(_tokens(spark, d).where(T.is_name(F.col("token"))).select(F.upper("token").alias("token")), noise).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- names


@query("SELECT p_type, string_agg(p_name, '|' ORDER BY p_name) AS declared FROM part GROUP BY p_type")
def symbol_index(spark, d):
    return resolve.symbol_index(read_table(spark, d, "part"), [], "p_type", "p_name").select("p_type", F.array_join("declared", "|").alias("declared"))


@query("""WITH fields AS (SELECT c_mktsegment || '-' || (c_custkey % 97) AS name, n_name AS owner, n_name || ':' || c_mktsegment || '-' || (c_custkey % 97) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey),
refs AS (SELECT o_orderkey AS ref, n_regionkey AS scope_id, CASE WHEN o_orderstatus = 'P' THEN n_name END AS owner, c_mktsegment || '-' || (o_orderkey % 101) AS name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
scope AS (SELECT n_regionkey AS scope_id, n_nationkey AS pref, n_name AS file FROM nation),
a AS (SELECT name, count(*) AS n_all, min(key) AS only_key, string_agg(key, '|' ORDER BY key) AS all_keys FROM fields GROUP BY name),
o AS (SELECT name, owner, count(*) AS n, min(key) AS key FROM fields GROUP BY name, owner),
b AS (SELECT ref, arg_min(o.key, pref) AS in_scope, arg_min(file, pref) AS file FROM refs JOIN a USING (name) JOIN scope USING (scope_id) JOIN o ON o.name = refs.name AND o.owner = file AND o.n = 1 WHERE refs.owner IS NULL AND n_all > 1 GROUP BY ref),
r AS (SELECT refs.ref, CASE WHEN refs.owner IS NOT NULL THEN CASE WHEN o.n = 1 THEN 'qualified' WHEN o.n IS NULL THEN 'qualified-missing' ELSE 'qualified-duplicate' END
  WHEN n_all = 1 THEN 'unique' WHEN n_all IS NULL THEN 'missing' WHEN b.in_scope IS NOT NULL THEN 'scoped' ELSE 'ambiguous' END AS outcome, o.key AS own_key, only_key, in_scope, file, all_keys
  FROM refs LEFT JOIN a USING (name) LEFT JOIN o ON o.name = refs.name AND o.owner = refs.owner LEFT JOIN b ON b.ref = refs.ref)
SELECT ref, outcome, CASE outcome WHEN 'qualified' THEN own_key WHEN 'unique' THEN only_key WHEN 'scoped' THEN in_scope END AS key, CASE WHEN outcome = 'scoped' THEN file END AS scoped,
CASE WHEN outcome IN ('scoped', 'ambiguous') THEN all_keys WHEN outcome = 'qualified-duplicate' THEN NULL ELSE '' END AS candidates FROM r""")
def resolve_scoped(spark, d):
    nation = read_table(spark, d, "nation")
    customer = read_table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are a fixed list
    one = F.lit(1).alias("program_id")
    name = F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 97).cast("string"))
    fields = customer.select(one, F.col("n_name").alias("owner"), name.alias("name"), F.concat_ws(":", "n_name", name).alias("key"))
    refs = read_table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        one, F.col("o_orderkey").alias("ref"), F.col("n_regionkey").alias("scope_id"), F.when(F.col("o_orderstatus") == "P", F.col("n_name")).alias("owner"),
        F.concat_ws("-", "c_mktsegment", (F.col("o_orderkey") % 101).cast("string")).alias("name"),
    )
    scopes = nation.select(one, F.col("n_regionkey").alias("scope_id"), F.col("n_nationkey").alias("pref"), F.col("n_name").alias("file"))
    found = resolve.resolve(refs, fields, scopes, ["program_id"])
    shown = F.when(F.col("outcome") == "qualified-duplicate", F.lit(None)).otherwise(F.array_join("candidates", "|"))
    return found.select("ref", "outcome", "key", "scoped", shown.alias("candidates"))


# ---------------------------------------------------------------- layouts

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]
_ORDER_SQL = ", ".join(_ORDER)
_FIELDS_SQL = f"""f AS (SELECT *, (l_partkey % 200)::INT AS start, (l_partkey % 200 + floor(l_quantity) - 1)::INT AS stop, floor(l_quantity)::INT AS length,
row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_SQL}, l_quantity, l_shipdate, l_returnflag, l_linestatus)::INT AS ord FROM lineitem)"""


def _fields(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER, "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    rows = read_table(spark, d, "lineitem").withColumn("start", (F.col("l_partkey") % 200).cast("int")).withColumn("length", F.floor("l_quantity").cast("int"))
    return rows.withColumn("stop", F.col("start") + F.col("length") - 1).withColumn("ord", F.row_number().over(w))


@query(f"WITH {_FIELDS_SQL} SELECT l_orderkey, ord, start, length, coalesce(greatest(1, max(start + length) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1)::INT AS next_free FROM f")
def layout_highwater(spark, d):
    return layout.high_water(_fields(spark, d), ["l_orderkey"], ["ord"]).select("l_orderkey", "ord", "start", "length", "next_free")


@query(f"""WITH {_FIELDS_SQL} SELECT a.l_orderkey, a.ord, string_agg(DISTINCT b.l_suppkey, ',' ORDER BY b.l_suppkey) AS others FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.ord <> b.ord AND b.start <= a.stop AND a.start <= b.stop GROUP BY 1, 2""")
def layout_overlap(spark, d):
    return layout.overlaps(_fields(spark, d), ["l_orderkey"], "ord", "l_suppkey").select("l_orderkey", "ord", _joined("others").alias("others"))


@query(f"""WITH {_FIELDS_SQL}, m AS (SELECT DISTINCT a.l_orderkey, a.ord, a.l_partkey FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.ord <> b.ord AND b.start <= a.stop AND a.start <= b.stop)
SELECT l_orderkey, array_to_string(list_transform((list(l_partkey ORDER BY l_partkey))[:8], lambda x: x::VARCHAR), ',') AS names FROM m GROUP BY 1""")
def overlap_flag_top8(spark, d):
    return layout.overlap_report(_fields(spark, d), ["l_orderkey"], "ord", "l_partkey").select("l_orderkey", _joined("names").alias("names"))


@query("""WITH f AS (SELECT n_regionkey, n_name, n_nationkey AS ord, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS redefines FROM nation)
SELECT n_regionkey, n_name AS target, redefines AS source FROM f WHERE redefines IS NOT NULL UNION ALL SELECT n_regionkey, redefines, n_name FROM f WHERE redefines IS NOT NULL""")
def alias_both_ways(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    f = read_table(spark, d, "nation").withColumn("redefines", F.lag("n_name").over(w)).withColumnRenamed("n_nationkey", "ord")
    return layout.aliases(f, ["n_regionkey"], "n_name", "redefines").select("n_regionkey", "target", "source")


@query("""SELECT c_nationkey AS nationkey, c_custkey AS target, s_suppkey AS source FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 50 = s_suppkey % 50""")
def pair_by_name(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), (F.col("c_custkey") % 50).alias("name"), F.col("c_custkey").alias("key"))
    s = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), (F.col("s_suppkey") % 50).alias("name"), F.col("s_suppkey").alias("key"))
    return layout.pairs_by_name(c, s, ["nationkey", "name"]).select("nationkey", F.col("t_key").alias("target"), F.col("s_key").alias("source"))


@query(f"""WITH {_FIELDS_SQL}, g AS (SELECT l_orderkey, ord, l_returnflag, nullif(start % 8, 0) AS start, nullif(length % 4, 0) AS length FROM f)
SELECT a.l_orderkey, a.ord AS target, min(b.ord) AS source FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.start IS NOT DISTINCT FROM b.start AND a.length IS NOT DISTINCT FROM b.length WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R' GROUP BY 1, 2""")
def pair_by_position(spark, d):
    nothing = F.lit(None).cast("int")
    g = _fields(spark, d).select("l_orderkey", "ord", "l_returnflag", F.when(F.col("start") % 8 != 0, F.col("start") % 8).otherwise(nothing).alias("start"), F.when(F.col("length") % 4 != 0, F.col("length") % 4).otherwise(nothing).alias("length"))
    targets = g.where("l_returnflag = 'R'").withColumnRenamed("ord", "target")
    sources = g.where("l_returnflag <> 'R'").withColumn("source", F.col("ord"))
    return layout.pairs_by_position(targets, sources, ["l_orderkey"]).select("l_orderkey", "target", "source")


@query("""SELECT l_orderkey, l_partkey AS target, o_custkey AS source, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def position_broadcast(spark, d):
    fields = read_table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target"))
    keys = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source"))
    return layout.positioned_by(fields, keys, ["l_orderkey"]).groupBy("l_orderkey", "target", "source").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- edges and access


@query("""SELECT l_orderkey AS target, l_partkey AS source, 'assignment' AS via FROM lineitem UNION ALL SELECT o_orderkey, o_custkey, 'move' FROM orders UNION ALL SELECT c_custkey, c_nationkey::BIGINT, 'sort-copy' FROM customer""")
def edge_union(spark, d):
    line, order, cust = (read_table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return edges.tagged_union({
        "assignment": line.select(F.col("l_orderkey").alias("target"), F.col("l_partkey").alias("source")), "move": order.select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("source")),
        "sort-copy": cust.select(F.col("c_custkey").alias("target"), F.col("c_nationkey").cast("long").alias("source")),
    })


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand, count(*)::BIGINT AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def lookup_table(spark, d):
    table = read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return edges.looked_up(rows, table, ["l_partkey"]).groupBy("l_orderkey", "l_linenumber", "l_partkey", "p_name", "p_brand").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, CASE WHEN len(a) > 1 THEN array_to_string(a[2:], ',') ELSE array_to_string(a, ',') END AS sources FROM (SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS a FROM part GROUP BY 1)""")
def lookup_sources(spark, d):
    return edges.lookup_sources(read_table(spark, d, "part").withColumn("ord", F.col("p_partkey")), ["p_brand"], "ord", "p_partkey").select("p_brand", _joined("sources").alias("sources"))


@query("""SELECT l_orderkey, list_contains(list(DISTINCT l_partkey % 50), l_orderkey % 50) AS accumulates FROM lineitem GROUP BY 1""")
def accumulate_flag(spark, d):
    rows = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("sources"))
    return rows.select("l_orderkey", edges.accumulates(F.col("l_orderkey") % 50, F.col("sources")).alias("accumulates"))


@query("""SELECT user_id, string_agg('set by event ' || event_id, '; ' ORDER BY ts, event_id) AS reasons FROM events WHERE event_type = 'error' GROUP BY 1""")
def opaque_reasons(spark, d):
    rows = read_table(spark, d, "events").where("event_type = 'error'").withColumn("reason", F.concat(F.lit("set by event "), F.col("event_id").cast("string")))
    return edges.ordered_list(rows, ["user_id"], ["ts", "event_id"], "reason", "reasons").select("user_id", F.array_join("reasons", "; ").alias("reasons"))


_ACCESS_SQL = """a AS (SELECT l_orderkey AS file, CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'write' ELSE CASE WHEN l_linestatus = 'F' THEN 'update' ELSE 'read' END END AS io FROM lineitem)"""


def _access(spark, d):
    io = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "write").when(F.col("l_linestatus") == "F", "update").otherwise("read")
    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), io.alias("io"))


@query(f"WITH {_ACCESS_SQL} SELECT file, io, count(*)::BIGINT AS n FROM a GROUP BY 1, 2")
def access_union(spark, d):
    return _access(spark, d).groupBy("file", "io").agg(F.count("*").alias("n"))


@query(f"""WITH {_ACCESS_SQL}, t AS (SELECT file, bool_or(io IN ('read', 'update')) AS r, bool_or(io IN ('write', 'update')) AS w FROM a GROUP BY 1)
SELECT coalesce(o_orderkey, file) AS file, CASE WHEN r AND w THEN 'read-write' WHEN r THEN 'read' WHEN w THEN 'write' ELSE 'unknown' END AS io FROM (SELECT DISTINCT o_orderkey FROM orders) FULL JOIN t ON o_orderkey = file""")
def file_io(spark, d):
    return edges.file_directions(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("file")), _access(spark, d), ["file"])


@query("""SELECT o_orderpriority, string_agg(o_custkey, ',' ORDER BY first_at, o_custkey) AS printed_by FROM (SELECT o_orderpriority, o_custkey, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) GROUP BY 1""")
def printed_by(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    return edges.first_seen(rows, ["o_orderpriority"], ["o_orderkey"], "o_custkey", "names").select("o_orderpriority", _joined("names").alias("printed_by"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first_at, event_type) AS flags FROM (SELECT user_id, event_type, min({'t': ts, 'e': event_id}) AS first_at FROM events GROUP BY 1, 2) GROUP BY 1""")
def flags_distinct_ordered(spark, d):
    return edges.first_seen(read_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "flags").select("user_id", F.array_join("flags", ",").alias("flags"))


@query("""SELECT event_id, user_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM events""")
def condition_depth(spark, d):
    e = read_table(spark, d, "events")
    return edges.condition_depth(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click"), F.col("event_type") == "purchase").select("event_id", "user_id", "depth")


# ---------------------------------------------------------------- flow

_GRAPH_SQL = """e AS MATERIALIZED (SELECT DISTINCT c_nationkey AS target, s_nationkey AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
stop AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 0)"""
# Walks run on each user's events, up to the operator's own limit of hops: an event comes from the one before it, a purchase from the purchase before it too, and
# some clicks from the event after them, which makes cycles. Errors are where a walk stops.
_EVENTS_SQL = """v AS (SELECT user_id, event_id, event_type, lag(event_id) OVER u AS before, lead(event_id) OVER u AS after, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS alike FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS MATERIALIZED (SELECT event_id AS target, before AS source FROM v WHERE before IS NOT NULL UNION SELECT event_id, alike FROM v WHERE event_type = 'purchase' AND alike IS NOT NULL UNION SELECT event_id, after FROM v WHERE event_type = 'click' AND event_id % 7 = 0 AND after IS NOT NULL),
stop AS (SELECT event_id AS node FROM events WHERE event_type = 'error')"""
_WALK_SQL = f"""{_EVENTS_SQL},
s AS MATERIALIZED (SELECT target, source, source IN (SELECT node FROM stop) OR source NOT IN (SELECT target FROM e) AS ends FROM e),
w AS (SELECT target AS sink, target AS node, [target] AS on_path, 0 AS hops, CAST(NULL AS VARCHAR) AS kind FROM (SELECT DISTINCT target FROM e)
  UNION ALL SELECT sink, source, list_append(on_path, source), hops + 1, CASE WHEN list_contains(on_path, source) THEN 'cyclic' WHEN ends THEN 'origin' WHEN hops + 1 = {flow.MAX_DEPTH} THEN 'truncated' END
  FROM w JOIN s ON node = target WHERE kind IS NULL)"""


def _event_links(spark, d):
    """program_id (the user), event_id, event_type and its neighbours: before, after, alike (the one before of its type)."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read_table(spark, d, "events").select(
        F.col("user_id").alias("program_id"), "event_id", "event_type", F.lag("event_id").over(by_user).alias("before"), F.lead("event_id").over(by_user).alias("after"),
        F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("alike"),
    )


def _graph(spark, d):
    """Which customer nation is supplied from which supplier nation."""
    line, order, cust, supp = (read_table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = (
        line.select("l_orderkey", "l_suppkey").join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return rows.select(F.lit(1).alias("program_id"), F.col("c_nationkey").alias("target"), F.col("s_nationkey").alias("source")).distinct()


def _stops(spark, d):
    return read_table(spark, d, "nation").where("n_regionkey = 0").select(F.lit(1).alias("program_id"), F.col("n_nationkey").alias("node"))


def _walked(spark, d):
    v = materialize(_event_links(spark, d), "events")
    to = lambda c: F.col(c).alias("source")
    e = v.select("program_id", F.col("event_id").alias("target"), to("before")).unionAll(v.where("event_type = 'purchase'").select("program_id", "event_id", "alike"))
    e = materialize(e.unionAll(v.where("event_type = 'click' and event_id % 7 = 0").select("program_id", "event_id", "after")).where("source is not null").distinct(), "graph")
    stops = v.where("event_type = 'error'").select("program_id", F.col("event_id").alias("node"))
    return flow.walk_levels(e, e.select("program_id", F.col("target").alias("node")).distinct(), stops, ["program_id"], flow.MAX_DEPTH)


@query(f"WITH {_GRAPH_SQL} SELECT target, string_agg(source, ',' ORDER BY source) AS incoming FROM e GROUP BY 1")
def adjacency(spark, d):
    e = _graph(spark, d).withColumn("ord", F.col("source"))
    return flow.adjacency(e, ["program_id"], "ord").select("target", F.array_join(F.transform("incoming", lambda s: s["source"].cast("string")), ",").alias("incoming"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def origins_semi(spark, d):
    return read_table(spark, d, "orders").join(read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def origins_anti(spark, d):
    return read_table(spark, d, "orders").join(read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(f"WITH {_GRAPH_SQL}, n AS (SELECT target AS node FROM e UNION SELECT source FROM e) SELECT node FROM n WHERE node IN (SELECT node FROM stop) OR node NOT IN (SELECT target FROM e)")
def walk_origins(spark, d):
    e = materialize(_graph(spark, d), "graph")
    nodes = e.select("program_id", F.col("target").alias("node")).union(e.select("program_id", "source")).distinct().withColumn("file", F.col("node"))
    read_only = _stops(spark, d).withColumnRenamed("node", "file")
    return flow.origins(nodes, e, read_only, ["program_id"]).select("node").distinct()


@query(f"WITH RECURSIVE {_WALK_SQL} SELECT sink, node, hops, kind, count(*)::BIGINT AS n FROM w WHERE kind IS NOT NULL GROUP BY ALL")
def flow_walk(spark, d):
    return _walked(spark, d).groupBy("sink", "node", "hops", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_WALK_SQL} SELECT sink, coalesce(string_agg(DISTINCT node, ',' ORDER BY node) FILTER (kind <> 'truncated'), '') AS origins, count(*)::BIGINT AS paths,
sum((kind = 'cyclic')::INT)::BIGINT AS cyclic, sum((kind = 'truncated')::INT)::BIGINT AS truncated FROM w WHERE kind IS NOT NULL GROUP BY 1""")
def flow_rollup(spark, d):
    return flow.rolled_up(_walked(spark, d), ["program_id"]).select("sink", _joined("origins").alias("origins"), "paths", "cyclic", "truncated")


@query(f"""WITH RECURSIVE {_WALK_SQL}, g AS (SELECT event_id AS sink, before AS gate FROM v WHERE event_type = 'signup' AND before IS NOT NULL)
SELECT g.sink, gate, coalesce(string_agg(DISTINCT node, ',' ORDER BY node) FILTER (node <> gate), '') AS traces_to FROM g LEFT JOIN (SELECT sink, node FROM w WHERE kind IS NOT NULL) x ON x.sink = gate GROUP BY 1, 2""")
def influence_trace(spark, d):
    gates = _event_links(spark, d).where("event_type = 'signup' and before is not null").select("program_id", F.col("event_id").alias("sink"), F.col("before").alias("gate"))
    return flow.influence_origins(gates, _walked(spark, d), ["program_id"]).select("sink", "gate", _joined("traces_to").alias("traces_to"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_discount > 0.09) THEN 'unmodelled' WHEN bool_or(l_tax > 0.07) THEN 'conditions' ELSE 'constants' END AS reason FROM lineitem GROUP BY 1""")
def no_origin_reason(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") > 0.09).alias("bad"), (F.col("l_tax") > 0.07).alias("gated"))
    return rows.groupBy("l_orderkey").agg(F.max("bad").alias("bad"), F.max("gated").alias("gated")).select("l_orderkey", flow.no_origin_reason(F.col("bad"), F.col("gated")).alias("reason"))


@query("""SELECT user_id, event_type, string_agg(r, ',' ORDER BY first_at, r) AS refs FROM (SELECT user_id, event_type, props AS r, min({'t': ts, 'e': event_id}) AS first_at FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def dropped_refs(spark, d):
    return edges.first_seen(read_table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "props", "refs").select("user_id", "event_type", F.array_join("refs", ",").alias("refs"))


@query("""SELECT cn.n_name AS from_file, sn.n_name AS to_file, count(*)::BIGINT AS fields, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS activities
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
WHERE cn.n_name <> sn.n_name GROUP BY 1, 2""")
def file_flow(spark, d):
    line, order, cust, supp, nation = (read_table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    names = nation.select("n_nationkey", "n_name")
    rows = (
        line.select("l_orderkey", "l_suppkey").join(order.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("string").alias("activity")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey", "activity").agg(F.count("*").alias("n"))
    )
    named = rows.join(names.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("from_file")), "c_nationkey").join(names.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("to_file")), "s_nationkey")
    # Paths are counted before the names are joined: fields is the sum of those counts.
    return flow.between_files(named.withColumn("activities", F.array("activity")), []).select("from_file", "to_file", "fields", F.array_join("activities", ",").alias("activities"))


# ---------------------------------------------------------------- manifest, bindings, dependents


@query("""SELECT rank::INT AS rank, kind, name, count(*)::BIGINT AS uses, string_agg(DISTINCT used_at, ',' ORDER BY used_at) AS touched_by FROM (
SELECT 0 AS rank, 'file' AS kind, p_brand AS name, p_size::VARCHAR AS used_at FROM part UNION ALL SELECT 1, 'table', n_name, n_regionkey::VARCHAR FROM nation
UNION ALL SELECT 2, 'program', c_mktsegment, c_nationkey::VARCHAR FROM customer UNION ALL SELECT 3, 'macro', o_orderpriority, o_orderstatus FROM orders) GROUP BY 1, 2, 3""")
def manifest_union(spark, d):
    part, nation, cust, order = (read_table(spark, d, t) for t in ("part", "nation", "customer", "orders"))
    made = manifest.artifacts({
        "file": part.select(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("used_at")), "table": nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("used_at")),
        "program": cust.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("used_at")), "macro": order.select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("used_at")),
    }, [])
    return made.select("rank", "kind", "name", "uses", F.array_join("touched_by", ",").alias("touched_by"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'virtual file' WHEN p_type LIKE 'S%' THEN 'instream table' WHEN p_retailprice > 1500 THEN 'report' END AS reason FROM part""")
def excluded_reasons(spark, d):
    tests = {"virtual file": F.col("p_size") < 10, "instream table": F.col("p_type").startswith("S"), "report": F.col("p_retailprice") > 1500}
    return manifest.split_exclusions(read_table(spark, d, "part"), tests).select("p_partkey", "reason")


@query("""SELECT c_custkey, name, coalesce(m.base, a.base, t.name) AS base, CASE WHEN m.base IS NOT NULL THEN 'map' WHEN a.base IS NOT NULL THEN 'resolver' END AS resolved_via
FROM (SELECT c_custkey, c_name AS name FROM customer) t LEFT JOIN (SELECT c_name AS name, 'M.' || c_mktsegment AS base FROM customer WHERE c_acctbal > 6000) m USING (name) LEFT JOIN (SELECT c_name AS name, 'R.' || c_mktsegment AS base FROM customer WHERE c_acctbal < 3000 OR c_acctbal > 8000) a USING (name)""")
def synonym_priority(spark, d):
    c = read_table(spark, d, "customer")
    tables = c.select("c_custkey", F.col("c_name").alias("name"))
    supplied = c.where("c_acctbal > 6000").select(F.col("c_name").alias("name"), F.concat(F.lit("M."), "c_mktsegment").alias("base"))
    answered = c.where("c_acctbal < 3000 or c_acctbal > 8000").select(F.col("c_name").alias("name"), F.concat(F.lit("R."), "c_mktsegment").alias("base"))
    return manifest.with_base_tables(tables, supplied, answered)


_DD_SQL = """dd AS (SELECT 'S' || (l_orderkey % 500) AS step, CASE WHEN l_linenumber = 1 THEN 'SYSIN' ELSE 'DD' || l_linenumber END AS ddname, 'LIB.P' || (l_partkey % 60) AS dataset,
CASE WHEN l_returnflag = 'R' THEN 'P' || (l_partkey % 60) END AS member, l_orderkey * 100 + l_suppkey AS ord FROM lineitem),
progs AS (SELECT DISTINCT 'P' || (p_partkey % 80) AS program FROM part)"""


def _allocations(spark, d):
    rows = read_table(spark, d, "lineitem")
    p = F.concat(F.lit("P"), (F.col("l_partkey") % 60).cast("string"))
    return rows.select(
        F.concat(F.lit("S"), (F.col("l_orderkey") % 500).cast("string")).alias("step"), F.when(F.col("l_linenumber") == 1, "SYSIN").otherwise(F.concat(F.lit("DD"), F.col("l_linenumber").cast("string"))).alias("ddname"),
        F.concat(F.lit("LIB."), p).alias("dataset"), F.when(F.col("l_returnflag") == "R", p).alias("member"), (F.col("l_orderkey") * 100 + F.col("l_suppkey")).alias("ord"),
    )


def _programs(spark, d):
    return read_table(spark, d, "part").select(F.concat(F.lit("P"), (F.col("p_partkey") % 80).cast("string")).alias("program")).distinct()


_STEPS_SQL = "s AS (SELECT program, upper(step) AS step, min(ord) AS ord FROM dd JOIN progs ON program = upper(coalesce(member, regexp_extract(dataset, '([^.]*)$', 1))) WHERE upper(ddname) = 'SYSIN' GROUP BY 1, 2)"


@query(f"WITH {_DD_SQL}, {_STEPS_SQL} SELECT program, step, ord FROM s")
def steps_running(spark, d):
    return manifest.steps_running(_allocations(spark, d), _programs(spark, d)).select("program", "step", "ord")


_ROUTES_SQL = f"""{_DD_SQL}, {_STEPS_SQL}, c AS (SELECT program, step, 0 AS rank, 'caller' AS route FROM s WHERE program IN ('P1', 'P2') AND step LIKE '%1' UNION SELECT program, step, 1, 'program' FROM s WHERE step LIKE '%7' UNION SELECT program, step, 2, 'member' FROM s),
r AS (SELECT program, step, route FROM c QUALIFY rank = min(rank) OVER (PARTITION BY program))"""


def _steps(spark, d):
    s = materialize(manifest.steps_running(_allocations(spark, d), _programs(spark, d)), "steps")
    return manifest.chosen_steps(s.where("program in ('P1', 'P2') and step like '%1'"), s.where("step like '%7'"), s)


@query(f"WITH {_ROUTES_SQL} SELECT program, step, route FROM r")
def bind_precedence(spark, d):
    return _steps(spark, d).select("program", "step", "route")


@query(f"""WITH {_ROUTES_SQL}, f AS (SELECT program, ddname FROM progs, (VALUES ('dd2'), ('DD3'), ('DD9')) v(ddname)), b AS (SELECT step, ddname, dataset, min(ord) AS ord FROM dd WHERE ddname <> 'SYSIN' GROUP BY 1, 2, 3),
x AS (SELECT f.program, f.ddname, b.step, b.dataset, b.ord, r.route FROM f JOIN r USING (program) JOIN b ON b.step = r.step AND upper(b.ddname) = upper(f.ddname)
  UNION ALL SELECT f.program, f.ddname, b.step, b.dataset, b.ord, 'name-alone' FROM f JOIN b ON upper(b.ddname) = upper(f.ddname) WHERE f.program NOT IN (SELECT program FROM r)),
l AS (SELECT program, ddname, step, route, string_agg(dataset, '+' ORDER BY ord, dataset) AS reading FROM x GROUP BY ALL),
g AS (SELECT program, ddname, count(DISTINCT reading) AS n, min(reading) AS one, string_agg(DISTINCT reading, '|' ORDER BY reading) AS candidates, min(route) AS route FROM l GROUP BY 1, 2)
SELECT f.program, f.ddname, CASE WHEN n = 1 THEN one END AS dataset, CASE WHEN n > 1 THEN candidates END AS candidates, route, CASE WHEN n = 1 THEN 'global' WHEN n > 1 THEN 'candidates' ELSE 'program-local' END AS identity FROM f LEFT JOIN g USING (program, ddname)""")
def bind_readings(spark, d):
    files = _programs(spark, d).withColumn("ddname", F.explode(F.array(F.lit("dd2"), F.lit("DD3"), F.lit("DD9"))))
    bindings = _allocations(spark, d).where("ddname <> 'SYSIN'").groupBy("step", "ddname", "dataset").agg(F.min("ord").alias("ord"))
    return manifest.bound_files(files, bindings, _steps(spark, d))


@query("""WITH asks AS (SELECT c_custkey, c_name AS name, c_mktsegment AS kind, c_acctbal > 0 AS asked FROM customer), cov AS (SELECT DISTINCT c_name AS name, c_mktsegment AS kind FROM customer WHERE c_nationkey <> 3),
ans AS (SELECT c_name AS name, c_mktsegment AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 AND o_orderstatus = 'F' GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN NOT asked THEN 'never-asked' WHEN cov.name IS NULL THEN 'unanswered' WHEN n IS NULL THEN 'none-found' ELSE 'provided' END AS state, CASE WHEN asked AND cov.name IS NOT NULL THEN coalesce(n, 0)::VARCHAR END AS n_dependents
FROM asks LEFT JOIN cov USING (name, kind) LEFT JOIN ans USING (name, kind)""")
def dependents_three_way(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") > 0).alias("asked"))
    covered = c.where("c_nationkey <> 3").select("name", "kind").distinct()
    answers = read_table(spark, d, "orders").where("o_orderstatus = 'F'").join(c.where("c_nationkey <> 3"), F.col("o_custkey") == F.col("c_custkey")).select("name", "kind")
    return manifest.dependents(c, answers, covered).select("c_custkey", "state", F.col("n_dependents").cast("string").alias("n_dependents"))


@query("""SELECT c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_nationkey || '|' || c_mktsegment) AS digest FROM customer""")
def golden_digest(spark, d):
    text = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment")
    return read_table(spark, d, "customer").select("c_custkey", F.sha2(text, 256).alias("digest"))


# ---------------------------------------------------------------- what programs do to records (an extension)


@query("""SELECT l_returnflag, l_linestatus, (2 - bit_count(grouping(l_returnflag, l_linestatus)::INT))::INT AS level, count(*)::BIGINT AS tally, sum(l_quantity::BIGINT)::BIGINT AS quantity, sum(l_linenumber)::BIGINT AS number
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def report_rollup(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("quantity"), F.col("l_linenumber").cast("long").alias("number"))
    return records.report(rows, ["l_returnflag", "l_linestatus"], ["quantity", "number"])


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 1000")
def sort_keys(spark, d):
    first = records.sorted_records(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", False), ("o_totalprice", True), ("o_orderkey", False)]).limit(1000)
    w = Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")  # over the thousand first only
    return first.select("o_orderkey", "o_orderpriority", F.row_number().over(w).alias("place"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1), b AS (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0)
SELECT k, a.n AS orders_n, coalesce(a.n > 0, FALSE) AS in_orders, segment AS customers_segment, segment IS NOT NULL AS in_customers FROM a FULL JOIN b USING (k)""")
def match_merge(spark, d):
    a = read_table(spark, d, "orders").where("o_custkey % 3 > 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    b = read_table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return records.matched({"orders": a, "customers": b}, ["k"])


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'dear' ELSE 'plain' END AS grade, CASE WHEN p_size > 40 THEN p_size * 2 END AS room FROM part")
def case_assign(spark, d):
    size = F.col("p_size")
    return read_table(spark, d, "part").select(
        "p_partkey", records.chosen([(size < 10, F.lit("small")), (F.col("p_retailprice") > 1500, F.lit("dear"))], F.lit("plain")).alias("grade"), records.chosen([(size > 40, size * 2)]).alias("room")
    )


@query("SELECT o_orderkey, c_mktsegment, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def point_get(spark, d):
    file = read_table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return records.positioned(read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), file, ["k"]).select("o_orderkey", "c_mktsegment", "found")


@query("""WITH ch AS (SELECT o_custkey AS c_custkey, 'NEW' || o_orderpriority AS c_mktsegment, CASE o_orderkey % 3 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS operation FROM orders WHERE o_orderkey % 7 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch) UNION ALL SELECT c_custkey, c_mktsegment FROM ch WHERE operation <> 'DELETE'""")
def write_file(spark, d):
    key = F.col("o_orderkey")
    changes = read_table(spark, d, "orders").where("o_orderkey % 7 = 0").select(
        F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("NEW"), "o_orderpriority").alias("c_mktsegment"), records.chosen([(key % 3 == 0, F.lit("ADD")), (key % 3 == 1, F.lit("UPDATE"))], F.lit("DELETE")).alias("operation"), key.alias("ord")
    )
    return records.written(read_table(spark, d, "customer").select("c_custkey", "c_mktsegment"), changes, ["c_custkey"])


@query("SELECT count(*)::BIGINT AS seen, sum((o_orderstatus = 'F')::INT)::BIGINT AS closed FROM orders")
def accumulators(spark, d):
    return records.accumulated(read_table(spark, d, "orders"), {"seen": F.lit(1), "closed": (F.col("o_orderstatus") == "F").cast("int")})


@query("SELECT c_custkey, c_name AS name, c_nationkey::VARCHAR AS nation, NULL::VARCHAR AS remark FROM customer")
def move_like(spark, d):
    source = records.copied_layout(read_table(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("string")), {"c_name": "name"})
    return records.moved_like(source, ["c_custkey", "name", "nation", "remark"]).withColumn("remark", F.col("remark").cast("string"))
