"""Lineage of a parsed corpus as Catalyst plans: references, edges, access, flow, roll-ups and manifests."""

from __future__ import annotations

import sys
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frontend.corpus import CONDITIONS, Facts
from ..functions import text as T
from ..operators import edges as E
from ..operators import layout, manifest, resolve
from ..operators.flow import MAX_DEPTH, MAX_PATHS, between_files, no_origin_reason
from ..sources.tables import materialize

P = ["program_id"]
S = ["program_id", "st"]


def _strings(*cols) -> Column:
    return F.array(*cols).cast("array<string>")


def described_field() -> Column:
    """A row of fields as a reader wants it."""
    return T.field_descriptor(*[F.col(c) for c in ("name", "owner", "storage", "start", "stop", "length", "fmt", "decimals")])


class Lineage:
    """All tables are lazy; those that several others use are written once."""

    def __init__(self, facts: Facts):
        self.facts = facts

    def _table(self, kind: str) -> DataFrame:
        return self.facts.table(kind)

    @cached_property
    def fields(self) -> DataFrame:
        return materialize(self._table("field"), "fields")

    @cached_property
    def described(self) -> DataFrame:
        """(program_id, key, field): every key's field (the first one of several) as a reader wants it."""
        return self.fields.groupBy("program_id", "key").agg(F.min_by(described_field(), "ord").alias("field"))

    @cached_property
    def statements(self) -> DataFrame:
        """Every statement with its parts by role: what it writes, reads and tests, as tokens in order."""
        s = self._table("statement").withColumnRenamed("ord", "st")
        files = self._table("file").groupBy("program_id").agg(F.collect_set("file").alias("declared"))
        s = s.join(files, "program_id", "left").withColumn("declared", F.coalesce("declared", _strings()))
        ops = F.col("operands")
        upper = F.transform(ops, F.upper)
        names = F.filter(ops, T.is_name)
        quiet = F.filter(ops, lambda t: T.is_name(t) & ~F.upper(t).isin(*T.NOISE_WORDS))
        first_name, first_quiet = F.upper(F.get(names, F.lit(0))), F.upper(F.get(quiet, F.lit(0)))
        has_to = F.array_contains(upper, "TO")
        before_to = F.slice(ops, F.lit(1), (F.greatest(F.array_position(upper, "TO"), F.lit(1)) - 1).cast("int"))
        verb = F.col("verb")
        is_like = F.coalesce(F.get(upper, F.lit(0)) == "LIKE", F.lit(False))
        moves = (verb == "MOVE") & ~is_like & (has_to | (F.size(ops) >= 2))
        assigns = (verb == "ASSIGN") & (F.size(ops) >= 3)
        last = F.slice(ops, F.greatest(F.size(ops), F.lit(1)), F.lit(1))
        usable = F.filter(F.when(has_to, T.words_after(ops, "TO")).otherwise(last), lambda t: T.is_name(t) & ~F.upper(t).isin(*T.NOISE_WORDS))
        shown_file = F.when((verb == "DISPLAY") & F.array_contains("declared", F.upper(F.get(ops, F.lit(0)))), F.upper(F.get(ops, F.lit(0))))
        target = (
            F.when(assigns, F.get(ops, F.lit(0))).when(moves, F.get(usable, F.lit(0)))
            .when(verb == "SEARCH", F.get(F.filter(T.words_after(ops, "GIVING"), T.is_name), F.lit(0)))
        )
        sources = (
            F.when(assigns, F.slice(ops, F.lit(3), F.size(ops))).when(moves, F.when(has_to, before_to).otherwise(F.slice(ops, F.lit(1), F.greatest(F.size(ops) - 1, F.lit(0)))))
            .when(verb == "SEARCH", F.when(F.array_contains(upper, "WITH"), T.words_between(ops, "WITH", "GIVING")).otherwise(_strings()))
            .when(verb == "DISPLAY", F.when(shown_file.isNotNull(), F.slice(ops, F.lit(2), F.size(ops))).otherwise(ops))
            .when(verb == "POINT", F.filter(ops, lambda t: F.upper(t) != first_quiet))
            .when(verb.isin("CALL", "LINK") & first_name.isNotNull(), F.when(F.array_contains(upper, "USING"), T.words_after(ops, "USING")).otherwise(F.slice(ops, F.lit(2), F.size(ops))))
            .otherwise(_strings())
        )
        hosts = F.when(verb == "SQL", F.transform(F.filter(ops, lambda t: t.startswith(":")), lambda t: F.regexp_replace(t, "^:+", ""))).otherwise(_strings())
        from_record = F.upper(F.get(F.filter(T.words_after(ops, "FROM"), T.is_name), F.lit(0)))
        pair = F.transform(F.filter(F.slice(ops, F.lit(2), F.size(ops)), T.is_name), F.upper)
        out = s.select(
            "program_id", "st", "activity_ord", "activity", "proc", "verb", "operands", "text", "line", "origin", "conditions",
            target.alias("target_token"), sources.alias("source_tokens"), hosts.alias("hosts"), F.when(verb == "SEARCH", first_name).when(verb.isin("CALL", "LINK", "PRINT"), first_name).alias("named"),
            first_quiet.alias("file"), shown_file.alias("shown_file"), F.when(verb.isin("PUT", "WRITE") & F.array_contains(upper, "FROM"), from_record).alias("from_record"),
            F.when((verb == "MOVE") & is_like & (F.size(pair) >= 2), pair).alias("like"), F.when(verb == "SQL", T.sql_tables(ops)).alias("tables"),
            F.get(F.filter(upper, lambda t: t.isin("ADD", "UPDATE", "DELETE")), F.lit(0)).alias("operation"),
            F.when((verb == "MOVE") & ~is_like & ~has_to & (F.size(ops) >= 2), True).otherwise(False).alias("bare_move"),
        )
        return materialize(out, "statements")

    # ---------------------------------------------------------------- scopes

    @cached_property
    def activities(self) -> DataFrame:
        return materialize(self._table("activity"), "activities")

    @cached_property
    def printed_by(self) -> DataFrame:
        """(program_id, report, activity, first statement): who prints each report."""
        printed = self.statements.where("verb = 'PRINT' and named is not null")
        return printed.groupBy("program_id", F.col("named").alias("report"), "activity").agg(F.min("st").alias("st"))

    @cached_property
    def scopes(self) -> DataFrame:
        """(program_id, scope_id, pref, file): A<activity> for statements; R<activity> for reports, from the activities that print them."""
        a = self.activities
        ins = a.select("program_id", F.concat(F.lit("A"), "ord").alias("scope_id"), F.col("ord").alias("a"), F.posexplode("inputs").alias("ord_in", "i")).where("i.file is not null")
        ins = ins.select("program_id", "scope_id", "a", F.col("ord_in").alias("ord"), F.col("i.file").alias("file"))
        outs = a.where("sort_to is not null").select("program_id", F.concat(F.lit("A"), "ord").alias("scope_id"), F.col("ord").alias("a"), F.lit(0).alias("ord"), F.col("sort_to").alias("file"))
        own = resolve.scopes_of(ins, outs, P)
        owners = a.select("program_id", F.concat(F.lit("A"), "ord").alias("scope_id"), F.col("ord").alias("a"), F.col("name").alias("activity"))
        reports = self._table("report").select("program_id", "report", F.concat(F.lit("R"), "activity_ord").alias("r"), F.col("activity_ord"))
        printing = (
            reports.join(self.printed_by.select("program_id", "report", "activity"), [*P, "report"]).join(owners, [*P, "activity"]).join(own, [*P, "scope_id"])
            .groupBy("program_id", "r", "file").agg(F.min(F.struct("a", "pref")).alias("at"))
        )
        w = Window.partitionBy("program_id", "r").orderBy("at")
        of_print = printing.select("program_id", F.col("r").alias("scope_id"), "file", (F.row_number().over(w) - 1).alias("pref"))
        without = reports.join(of_print.select("program_id", F.col("scope_id").alias("r")).distinct(), [*P, "r"], "left_anti")
        fallback = without.join(own, (without["program_id"] == own["program_id"]) & (own["scope_id"] == F.concat(F.lit("A"), without["activity_ord"]))).select(without["program_id"], F.col("r").alias("scope_id"), "file", "pref")
        return materialize(own.select("program_id", "scope_id", "file", "pref").unionByName(of_print).unionByName(fallback), "scopes")

    # ---------------------------------------------------------------- references

    @cached_property
    def report_items(self) -> DataFrame:
        """Every field reference of a report: section order, sink key, kind and detail."""
        r = self._table("report")
        base = ["program_id", "activity_ord", "report", "line"]

        def part(rank: int, kind: str, exploded: DataFrame, key: Column, field: Column, order: list[Column]) -> DataFrame:
            return exploded.select(*base, F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("sink"), field.alias("field"), F.array(*[c.cast("int") for c in order]).alias("at"))

        name = F.col("report")
        seq = r.select(*base, F.posexplode("sequence").alias("i", "x"))
        con = r.select(*base, F.posexplode("control").alias("i", "x")).where("x.field <> 'FINAL'")
        sums = r.select(*base, F.posexplode("sums").alias("i", "x"))
        titles = r.select(*base, F.posexplode("titles").alias("i", "t")).select(*base, "i", "t.index", F.posexplode("t.items").alias("j", "x")).where("x.kind = 'field'")
        lines = r.select(*base, F.posexplode("lines").alias("i", "t")).select(*base, "i", "t.index", F.posexplode(F.filter("t.items", lambda x: x["kind"] == "field")).alias("j", "x"))
        out = part(0, "report-sequence", seq, F.concat(F.lit("@"), name, F.lit(".SEQUENCE."), "x.field"), F.col("x.field"), [F.col("i")])
        out = out.unionByName(part(1, "report-control", con, F.concat(F.lit("@"), name, F.lit(".CONTROL."), "x.field"), F.col("x.field"), [F.col("i")]))
        out = out.unionByName(part(2, "report-sum", sums, F.concat(F.lit("@"), name, F.lit(".SUM."), "x"), F.col("x"), [F.col("i")]))
        out = out.unionByName(part(3, "report-title", titles, F.concat(F.lit("@"), name, F.lit(".TITLE"), "index", F.lit("."), (F.col("j") + 1).cast("string")), F.col("x.value"), [F.col("i"), F.col("j")]))
        return out.unionByName(part(4, "report-detail", lines, F.concat(F.lit("@"), name, F.lit(".LINE"), "index", F.lit("."), (F.col("j") + 1).cast("string")), F.col("x.value"), [F.col("i"), F.col("j")]))

    @cached_property
    def references(self) -> DataFrame:
        """Every name that must mean a field, resolved once: program_id, ref, role, st, pos, token and what resolve() adds."""
        s = self.statements
        scope = F.concat(F.lit("A"), "activity_ord").alias("scope_id")

        def asked(df: DataFrame, role: str, tokens: Column, quiet: bool) -> DataFrame:
            rows = df.select("program_id", "st", scope, F.lit(role).alias("role"), F.posexplode(tokens).alias("pos", "token"))
            if quiet:
                rows = rows.where(T.is_name(F.col("token")) & ~T.is_constant(F.col("token")) & ~F.upper("token").isin(*T.NOISE_WORDS))
            return rows

        refs = asked(s.where("target_token is not null"), "target", F.array("target_token"), False)
        refs = refs.unionByName(asked(s, "source", F.col("source_tokens"), True)).unionByName(asked(s, "host", F.col("hosts"), False))
        tested = s.select("program_id", "st", "activity_ord", F.posexplode("conditions").alias("c", "x")).select("program_id", "st", scope, F.concat(F.lit("cond"), "c").alias("role"), F.posexplode("x.fields").alias("pos", "token"))
        refs = refs.unionByName(tested)
        printed = self.report_items.select("program_id", F.col("activity_ord").alias("st"), F.concat(F.lit("R"), "activity_ord").alias("scope_id"), F.concat(F.lit("report:"), "sink", F.lit(":"), F.array_join(F.transform("at", lambda x: x.cast("string")), ".")).alias("role"), F.lit(0).alias("pos"), F.col("field").alias("token"))
        refs = refs.unionByName(printed)
        refs = refs.select(
            "program_id", F.concat_ws("|", F.col("st").cast("string"), "role", F.col("pos").cast("string")).alias("ref"), "scope_id", "st", "role", "pos", "token",
            T.owner_part(F.col("token")).alias("owner"), T.name_part(F.col("token")).alias("name"),
        )
        fields = self.fields.select("program_id", "owner", "name", "key")
        return materialize(resolve.with_reason(resolve.resolve(refs, fields, self.scopes, P)), "references")

    @cached_property
    def conditions(self) -> DataFrame:
        """(program_id, st, conditions): tested names as field keys where they resolve, as written where they don't; each once."""
        keyed = (
            self.references.where(F.col("role").startswith("cond")).groupBy("program_id", "st", "role")
            .agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("key", "token").alias("k")))), lambda x: x["k"])).alias("keys"))
            .groupBy("program_id", "st").agg(F.map_from_entries(F.collect_list(F.struct("role", "keys"))).alias("by_frame"))
        )
        joined = self.statements.select("program_id", "st", "conditions").join(keyed, S, "left")
        return joined.select(
            "program_id", "st",
            F.transform(
                "conditions",
                lambda c, i: c.withField("fields", F.coalesce(F.try_element_at("by_frame", F.concat(F.lit("cond"), i.cast("string"))), c["fields"])),
            ).alias("conditions"),
        )

    # ---------------------------------------------------------------- edges

    @cached_property
    def _parts(self) -> DataFrame:
        """Statements with resolved target, ordered distinct source keys, constants and conditions."""
        r = self.references
        targets = r.where("role = 'target' and key is not null").select("program_id", "st", F.col("key").alias("target"))
        sources = r.where("role = 'source' and key is not null").groupBy(*S).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])).alias("keys"))
        s = self.statements.drop("conditions").join(self.conditions, S).join(targets, S, "left").join(sources, S, "left")
        s = s.withColumn("keys", F.coalesce("keys", _strings())).withColumn("constants", F.filter("source_tokens", lambda t: T.is_constant(t)))
        return materialize(s, "parts")

    @cached_property
    def edges(self) -> DataFrame:
        """program_id, edge_ord, target, sources, constants, via, operators, activity, proc, line, origin, statement, conditions, note, accumulates."""
        p, fields, files = self._parts, self.fields, self._table("file").select("program_id", "file", F.col("ord").alias("file_ord"))
        base = ["program_id", "activity", "proc", "line", "origin", F.col("text").alias("statement"), "conditions"]
        none = _strings()

        def order(phase: int, *cols) -> Column:
            return F.array(F.lit(phase), *[(c if isinstance(c, Column) else F.col(c)).cast("int") for c in cols]).alias("at")

        no_ops = none.alias("operators")
        at_st = order(1, "activity_ord", "st")
        parts = {
            "assignment": p.where("verb = 'ASSIGN' and target is not null").select(*base, at_st, "target", F.col("keys").alias("sources"), "constants", F.filter(F.slice("operands", F.lit(3), F.size("operands")), lambda t: t.isin("+", "-", "*", "/")).alias("operators")),
            "move": p.where("verb = 'MOVE' and target is not null").select(*base, at_st, "target", F.col("keys").alias("sources"), "constants", no_ops),
            "display": p.where("verb = 'DISPLAY' and size(keys) + size(constants) > 0").select(*base, at_st, F.concat(F.lit("@DISPLAY."), F.coalesce("shown_file", F.lit("SYSPRINT")), F.lit("."), F.col("line").cast("string")).alias("target"), F.col("keys").alias("sources"), "constants", no_ops),
        }
        described = E.lookup_sources(fields.where("owner is not null"), [*P, "owner"], "ord", "key")
        looked = p.where("verb = 'SEARCH' and target is not null").join(described.select("program_id", F.col("owner").alias("named"), F.col("sources").alias("described")), [*P, "named"], "left")
        parts["table-lookup"] = looked.select(*base, at_st, "target", F.concat(F.coalesce("described", none), "keys").alias("sources"), "constants", no_ops)
        pos = layout.positioned_by(fields.where("owner is not null").select("program_id", F.col("owner").alias("file"), "key", F.col("ord").alias("f_ord")), p.where("verb = 'POINT' and size(keys) > 0"), [*P, "file"])
        parts["positioned-by"] = pos.select(*base, order(1, "activity_ord", "st", "f_ord"), F.col("key").alias("target"), F.col("keys").alias("sources"), none.alias("constants"), no_ops)
        slim = fields.where("owner is not null").select("program_id", F.col("owner").alias("file"), "name", "key", "start", "length", "ord")
        first = slim.groupBy("program_id", "file", "name").agg(F.min_by("key", "ord").alias("source"))
        like = p.where("like is not null").withColumn("from_file", F.get("like", F.lit(0))).withColumn("to_file", F.get("like", F.lit(1)))
        named = like.join(slim.withColumnRenamed("file", "to_file"), [*P, "to_file"]).join(first.withColumnRenamed("file", "from_file"), [*P, "from_file", "name"])
        same_name = named.select(*base, order(1, "activity_ord", "st", "ord"), F.col("key").alias("target"), F.array("source").alias("sources"), none.alias("constants"), no_ops)
        parts["move-like"] = same_name
        copies = p.where("from_record is not null and file is not null").select(*[c for c in p.columns if c not in ("target",)])
        to = copies.join(slim, [*P, "file"]).select(*copies.columns, F.col("key").alias("target"), "start", "length", "ord")
        src = slim.select("program_id", F.col("file").alias("from_record"), "start", "length", F.col("key").alias("source"), "ord")
        paired = layout.pairs_by_position(to.select("program_id", "st", "from_record", "target", "start", "length"), _by_statement(src, copies), [*P, "st", "from_record"]).select("program_id", "st", "target", "source")
        met = to.join(paired, [*S, "target"])
        parts["record-copy"] = met.select(*base, order(1, "activity_ord", "st", "ord"), "target", F.array("source").alias("sources"), none.alias("constants"), no_ops)
        empty = F.array().cast(CONDITIONS).alias("conditions")
        alias = layout.aliases(fields.where("owner is not null").select("program_id", "owner", "name", "redefines", "ord", "line", "origin", "raw").withColumn("owner", F.col("owner")), [*P, "owner"], "name", "redefines")
        declared = fields.select("program_id", "ord", "line", "origin", "raw")
        both = alias.join(declared, [*P, "ord"])
        parts["redefine-alias"] = both.select("program_id", F.lit("").alias("activity"), F.lit(None).cast("string").alias("proc"), "line", "origin", F.col("raw").alias("statement"), empty, order(0, "ord", "side"), F.concat_ws(":", "owner", "target").alias("target"), F.array(F.concat_ws(":", "owner", "source")).alias("sources"), none.alias("constants"), no_ops)
        items = self.report_items.withColumn("role", F.concat(F.lit("report:"), "sink", F.lit(":"), F.array_join(F.transform("at", lambda x: x.cast("string")), "."))).withColumnRenamed("at", "item_at")
        hits = self.references.where(F.col("role").startswith("report:") & F.col("key").isNotNull()).select("program_id", F.col("st").alias("activity_ord"), "role", "key")
        names = self.activities.select("program_id", F.col("ord").alias("activity_ord"), F.col("name").alias("activity"))
        shown = items.join(hits, [*P, "activity_ord", "role"]).join(names, [*P, "activity_ord"])
        for kind in ("report-sequence", "report-control", "report-sum", "report-title", "report-detail"):
            parts[kind] = shown.where(F.col("kind") == kind).select(
                "program_id", "activity", F.lit(None).cast("string").alias("proc"), "line", F.lit(None).cast("string").alias("origin"), F.concat(F.lit("REPORT "), "report").alias("statement"), empty,
                F.concat(F.array(F.lit(2), F.col("activity_ord").cast("int"), F.col("rank")), F.col("item_at")).alias("at"), F.col("sink").alias("target"), F.array("key").alias("sources"), none.alias("constants"), no_ops,
            )
        sorts = self.activities.where("kind = 'SORT' and sort_to is not null").select("program_id", F.col("ord").alias("a"), F.col("name").alias("activity"), "line", F.col("sort_to").alias("to_file"), F.get("inputs", F.lit(0))["file"].alias("from_file"))
        known = sorts.join(files.select("program_id", F.col("file").alias("to_file")), [*P, "to_file"], "left_semi")
        carried = known.join(slim.withColumnRenamed("file", "to_file"), [*P, "to_file"]).join(first.withColumnRenamed("file", "from_file"), [*P, "from_file", "name"])
        parts["sort-copy"] = carried.select("program_id", "activity", F.lit(None).cast("string").alias("proc"), "line", F.lit(None).cast("string").alias("origin"), F.concat_ws(" ", F.lit("SORT"), "from_file", F.lit("TO"), "to_file").alias("statement"), empty, order(3, "a", "ord"), F.col("key").alias("target"), F.array("source").alias("sources"), none.alias("constants"), no_ops)
        union = E.tagged_union(parts)
        w = Window.partitionBy("program_id").orderBy("at", "via", "target")
        return materialize(union.withColumn("edge_ord", F.row_number().over(w) - 1).withColumn("accumulates", E.accumulates(F.col("target"), F.col("sources"))).drop("at"), "edges")

    # ---------------------------------------------------------------- access, calls, sql

    @cached_property
    def access(self) -> DataFrame:
        """program_id, file, activity, io, how, line, keys, operation, conditions, in order of at."""
        a, p = self.activities, self._parts
        empty, none = F.array().cast(CONDITIONS).alias("conditions"), _strings()
        heads = a.select("program_id", "ord", "name", "kind", "line", F.posexplode("inputs").alias("i", "x")).where("x.file is not null").select(
            "program_id", F.col("x.file").alias("file"), F.col("name").alias("activity"), F.lit("read").alias("io"), F.concat("kind", F.lit(" INPUT")).alias("how"), "line", F.coalesce("x.keys", none).alias("keys"), F.lit(None).cast("string").alias("operation"), empty, F.array("ord", F.lit(-2), "i").alias("at")
        )
        sorts = a.where("kind = 'SORT' and sort_to is not null").select(
            "program_id", F.col("sort_to").alias("file"), F.col("name").alias("activity"), F.lit("write").alias("io"), F.lit("SORT TO").alias("how"), "line", F.col("sort_keys.field").alias("keys"), F.lit(None).cast("string").alias("operation"), empty, F.array("ord", F.lit(-1), F.lit(0)).alias("at")
        )
        io = F.when(F.col("verb").isin("GET", "READ", "RETRIEVE", "SELECT", "POINT", "SEARCH"), "read").when((F.col("verb") == "WRITE") & F.col("operation").isin("UPDATE", "DELETE"), "update").otherwise("write")
        declared = self._table("file").select("program_id", F.col("file").alias("named"), F.lit(True).alias("is_file"))
        used = p.join(declared, [*P, "named"], "left")
        file = F.when(F.col("verb") == "DISPLAY", F.col("shown_file")).when(F.col("verb") == "SEARCH", F.when(F.col("is_file") & F.col("target").isNotNull(), F.col("named"))).otherwise(F.col("file"))
        rows = used.where(F.col("verb").isin("GET", "READ", "RETRIEVE", "SELECT", "POINT", "PUT", "WRITE", "DISPLAY", "SEARCH")).select(
            "program_id", file.alias("file"), "activity", io.alias("io"), F.col("verb").alias("how"), "line", F.when(F.col("verb").isin("POINT", "SEARCH"), F.col("keys")).otherwise(none).alias("keys"), F.when(F.col("verb") == "WRITE", F.col("operation")).alias("operation"), "conditions", F.array("activity_ord", F.lit(0), "st").alias("at")
        ).where("file is not null")
        return materialize(heads.unionByName(sorts).unionByName(rows), "access")

    @cached_property
    def file_io(self) -> DataFrame:
        return E.file_directions(self._table("file").select("program_id", "file"), self.access, ["program_id", "file"])

    @cached_property
    def calls(self) -> DataFrame:
        return self._parts.where("verb in ('CALL', 'LINK') and named is not null").select("program_id", F.col("named").alias("called"), "activity", "line", F.col("keys").alias("arguments"), "conditions", "st")

    @cached_property
    def sql(self) -> DataFrame:
        return self.statements.where("verb = 'SQL'").select("program_id", "activity", "line", F.col("text").alias("statement"), "tables", F.col("hosts").alias("host_fields"), "st")

    @cached_property
    def opaque(self) -> DataFrame:
        """(program_id, key, reasons): what a value may come from outside of everything modelled here."""
        called = self.calls.select("program_id", "st", F.posexplode("arguments").alias("pos", "key"), F.concat(F.lit("passed to CALL "), "called", F.lit(" at line "), F.col("line").cast("string"), F.lit(", which may change it")).alias("reason"))
        hosts = self.references.where("role = 'host' and key is not null").select("program_id", "st", "pos", "key").join(self.sql, S).select(
            "program_id", "st", "pos", "key", F.concat(F.lit("set by SQL at line "), F.col("line").cast("string"), F.lit(" from "), F.when(F.size("tables") > 0, F.array_join("tables", ", ")).otherwise("an unnamed table")).alias("reason")
        )
        return E.ordered_list(called.unionByName(hosts), ["program_id", "key"], ["st", "pos"], "reason", "reasons")

    @cached_property
    def unresolved(self) -> DataFrame:
        """References without a field. A statement's sources count only where its target resolves; report references carry no line."""
        r = self.references.where("key is null and not startswith(role, 'cond')")
        s = self._parts.select("program_id", "st", "verb", "activity", "line", F.col("text").alias("statement"), "target")
        of_report = F.col("role").startswith("report:")
        own = r.where(~of_report).join(s, S).where("role <> 'source' or verb not in ('ASSIGN', 'MOVE', 'SEARCH') or target is not null")
        rows = own.select("program_id", F.col("token").alias("reference"), "role", "reason", "activity", "line", "statement", "candidates", "st", "pos")
        reports = r.where(of_report).select("program_id", F.col("token").alias("reference"), F.lit("report").alias("role"), "reason", F.lit(None).cast("string").alias("activity"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("statement"), "candidates", "st", "pos")
        return rows.unionByName(reports)

    @cached_property
    def overlaps(self) -> DataFrame:
        return layout.overlaps(self.fields.where("owner is not null"), ["program_id", "owner"], "ord", "name")

    # ---------------------------------------------------------------- flow

    @cached_property
    def sinks(self) -> DataFrame:
        """(program_id, sink, kind, file, place): fields of written files by file and declaration, then other sinks by key."""
        written = self.file_io.where("io in ('write', 'read-write')")
        fields = self.fields.where("owner is not null").join(written.select("program_id", F.col("file").alias("owner")), [*P, "owner"])
        by_field = fields.select("program_id", F.col("key").alias("sink"), F.lit("file-field").alias("kind"), F.col("owner").alias("file"), F.struct(F.lit(0).alias("side"), F.col("owner").alias("name"), "ord").alias("place"))
        others = self.edges.where(F.col("target").startswith("@")).groupBy("program_id", F.col("target").alias("sink")).agg(F.min_by("via", "edge_ord").alias("kind"))
        by_key = others.select("program_id", "sink", "kind", F.lit(None).cast("string").alias("file"), F.struct(F.lit(1).alias("side"), F.col("sink").alias("name"), F.lit(0).alias("ord")).alias("place"))
        return by_field.unionByName(by_key)

    @cached_property
    def paths(self) -> DataFrame:
        """Every route from a sink (or from a gating field) back to where it ends, exactly in the order of edges and sources.

        One program's edges are one row: bounded by the program, not by the corpus.
        """
        e = self.edges.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("edge_ord", "target", "sources", "constants", "via", "operators", "activity", "proc", "line", "origin", "statement", "conditions", "accumulates"))).alias("edges"))
        io = self.file_io.where("io = 'read'").groupBy("program_id").agg(F.collect_set("file").alias("read_only"))
        fields = self.fields.groupBy("program_id").agg(F.collect_list(F.struct("key", "owner")).alias("fields"))
        opaque = self.opaque.groupBy("program_id").agg(F.collect_list(F.struct("key", "reasons")).alias("opaque"))
        sinks = self.sinks.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("place", "sink")))["sink"].alias("sinks"))
        rows = e.join(sinks, P).join(io, P, "left").join(fields, P, "left").join(opaque, P, "left")
        return materialize(rows.mapInArrow(_walk_batches, PATHS), "paths")

    @cached_property
    def field_flow(self) -> DataFrame:
        """Per sink: origins in order of first sight, constants, gating fields, and why there is no origin if there is none."""
        own = self.paths.where("is_sink")
        dropped = self.unresolved.where("line is not null").select("program_id", "activity", "line", "statement").distinct().withColumn("dropped", F.lit(True))
        end = F.get("hops", F.lit(0))
        rows = own.select("*", end["activity"].alias("activity"), end["line"].alias("line"), end["statement"].alias("statement")).join(dropped, [*P, "activity", "line", "statement"], "left")
        listed = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path_ord", c))), lambda s: s[c])))
        flow = rows.groupBy("program_id", "sink").agg(
            F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("origin").isNotNull(), F.struct("path_ord", "origin")))), lambda s: s["origin"])).alias("origins"),
            F.count("origin").alias("n_paths"), listed("constants").alias("constants"), listed("influenced_by").alias("influenced_by"), F.max(F.col("cyclic")).alias("cyclic"), F.max(F.col("truncated")).alias("truncated"), F.max("cut").alias("cut"),
            F.max(F.when(F.col("origin").isNull(), F.coalesce("dropped", F.lit(False)) | (F.size("constants") == 0)).otherwise(F.lit(False))).alias("bad"),
        )
        reason = F.when(F.size("origins") == 0, no_origin_reason(F.col("bad") | F.col("cut"), F.size("influenced_by") > 0))
        return flow.withColumn("no_origin_reason", reason).withColumn("path_limit", F.when((F.size("origins") == 0) & F.col("cut"), MAX_PATHS)).drop("bad")

    @cached_property
    def influences(self) -> DataFrame:
        """(program_id, gate, traces_to): where each gating field comes from; nothing for one that is an origin itself."""
        rows = self.paths.where("not is_sink and origin is not null and origin <> sink")
        return E.first_seen(rows, ["program_id", "sink"], ["path_ord"], "origin", "traces_to").withColumnRenamed("sink", "gate")

    @cached_property
    def file_flow(self) -> DataFrame:
        """(program_id, from_file, to_file, fields, activities): paths between files; a file with itself isn't one."""
        owners = self.fields.where("owner is not null").select("program_id", "key", "owner").distinct()
        own = self.paths.where("is_sink and origin is not null")
        rows = own.join(owners.select("program_id", F.col("key").alias("sink"), F.col("owner").alias("to_file")), [*P, "sink"]).join(owners.select("program_id", F.col("key").alias("origin"), F.col("owner").alias("from_file")), [*P, "origin"])
        return between_files(rows.select("program_id", "from_file", "to_file", F.lit(1).alias("n"), F.filter(F.col("hops")["activity"], lambda a: a != "").alias("activities")), P)

    # ---------------------------------------------------------------- manifest

    @cached_property
    def artifacts(self) -> DataFrame:
        """program_id, rank, kind, name, uses, touched_by, status, role: files, tables, programs and macros that a program needs.

        touched_by says where: the activities that read or write a file, run a table's SQL or call a program, the files that a program is the exit of,
        the macros that a macro is used in (its lines where it is used by the program itself).
        """
        own = self._table("file")
        kept = own.where("not is_virtual and not instream").select("program_id", "file").join(self.file_io, [*P, "file"])
        touches = self.access.select("program_id", "file", F.col("activity").alias("used_at"))
        files = kept.join(touches, [*P, "file"], "left").select("program_id", F.col("file").alias("name"), "used_at", F.col("io").alias("status"), F.lit("ddname").alias("role"))
        words = F.split(F.trim(F.regexp_replace("sql_text", "[,()]", " ")), r"\s+")
        pairs = F.arrays_zip(words.alias("k"), F.slice(words, F.lit(2), F.size(words)).alias("t"))
        sql_files = own.where("organization = 'SQL' and sql_text is not null").select("program_id", "file", F.explode(F.filter(pairs, lambda p: F.upper(p["k"]).isin("FROM", "JOIN") & p["t"].isNotNull())).alias("p"))
        tables = self.sql.select("program_id", F.explode("tables").alias("name"), F.col("activity").alias("used_at")).unionByName(sql_files.select("program_id", F.upper("p.t").alias("name"), F.col("file").alias("used_at")))
        called = self.calls.select("program_id", F.col("called").alias("name"), F.col("activity").alias("used_at"), F.lit("called").alias("role"))
        exits = own.where("exit_program is not null").select("program_id", F.col("exit_program").alias("name"), F.col("file").alias("used_at"), F.lit("file exit").alias("role"))
        macros = self._table("macro_use").select(
            "program_id", "name", F.coalesce("in_macro", F.col("line").cast("string")).alias("used_at"), F.when(F.col("resolved"), "expanded").otherwise("unresolved").alias("status"), F.lit("compile-time").alias("role")
        )
        # The least role and status of a name's uses: called before file exit, expanded only if no use is unresolved.
        macros = macros.withColumn("status", F.when(F.min((F.col("status") == "expanded").cast("int")).over(Window.partitionBy("program_id", "name")) == 1, "expanded").otherwise("unresolved"))
        return manifest.artifacts({"file": files, "db2-table": tables, "program": called.unionByName(exits), "macro": macros}, P)

    @cached_property
    def excluded(self) -> DataFrame:
        files = manifest.split_exclusions(self._table("file"), {"virtual-file": F.col("is_virtual"), "instream-table": F.col("instream")}).where("reason is not null").select("program_id", F.col("file").alias("name"), F.col("reason").alias("kind"))
        return files.unionByName(self._table("report").select("program_id", F.col("report").alias("name"), F.lit("report").alias("kind")))

    @cached_property
    def flags(self) -> DataFrame:
        """program_id, code, line, message and place: parser flags in their order, then those of the lineage by sort and statement, each once."""
        line = F.lit(None).cast("int").alias("line")
        parts = [
            self._table("flag").select("program_id", "code", "line", "message", F.col("ord").alias("at")),
            self.references.where("outcome = 'scoped'").select("program_id", F.lit("scoped").alias("code"), line, F.concat(F.upper("token"), F.lit(": several files define it, taken from "), "scoped", F.lit(", a file of the activity")).alias("message"), F.col("st").alias("at")),
            self.statements.where("bare_move").select("program_id", F.lit("move-without-to").alias("code"), "line", F.lit("MOVE without TO: the last operand is the target").alias("message"), F.col("st").alias("at")),
            self.statements.where("verb = 'SQL'").select("program_id", F.lit("sql").alias("code"), "line", F.lit("SQL: its tables are listed, its columns have no edges").alias("message"), F.col("st").alias("at")),
            self.statements.where("from_record is not null").select("program_id", F.lit("record-copy").alias("code"), "line", F.lit("record written from another record: fields at equal positions are paired").alias("message"), F.col("st").alias("at")),
            layout.overlap_report(self.fields.where("owner is not null"), ["program_id", "owner"], "ord", "name", "redefines").select(
                "program_id", F.lit("overlap").alias("code"), line, F.concat("owner", F.lit(": bytes in common with other fields, which makes no edge: "), F.array_join("names", ", ")).alias("message"), F.lit(0).alias("at")
            ),
        ]
        parts = [df.withColumn("sort", F.lit(i)) for i, df in enumerate(parts)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        # Parser flags stay as often as they were raised.
        again = F.when(F.col("sort") == 0, F.col("at"))
        return out.groupBy("program_id", "code", "line", "message", again.alias("_again")).agg(F.min(F.struct("sort", "at")).alias("place")).drop("_again")


def _by_statement(fields: DataFrame, copies: DataFrame) -> DataFrame:
    """Source fields once for each statement that copies their record."""
    return copies.select("program_id", "st", "from_record").distinct().join(fields, ["program_id", "from_record"])


_HOP = "struct<target:string,via:string,activity:string,proc:string,line:int,origin:string,statement:string,operators:array<string>,accumulates:boolean,tests:array<string>>"
PATHS = (
    f"program_id string, sink string, is_sink boolean, path_ord int, origin string, hops array<{_HOP}>, constants array<string>, influenced_by array<string>, opaque array<string>, "
    "cyclic boolean, truncated boolean, cut boolean"
)


class Walker:
    """Backward routes over one program's edges, depth first, at most MAX_DEPTH hops each and about MAX_PATHS for each start.

    The limit on paths is looked at when a node is entered and when a branch returns, so the direct ends of one node stay together.
    """

    def __init__(self, edges: list[dict], read_only: set[str], owners: dict[str, str | None]):
        self.incoming: dict[str, list[dict]] = {}
        for e in edges:
            self.incoming.setdefault(e["target"], []).append(e)
        self.read_only, self.owners = read_only, owners
        self.known: dict[str, tuple[list[dict], bool]] = {}

    def stops_at(self, key: str) -> bool:
        """A field of a file that is only read, or one that nothing here writes."""
        return key in self.owners and (self.owners[key] in self.read_only or key not in self.incoming)

    def routes(self, start: str) -> tuple[list[dict], bool]:
        if start in self.known:
            return self.known[start]
        found: list[dict] = []
        cut = False

        def ends(origin, hops, gates, constants, **more):
            found.append({"origin": origin, "hops": hops, "gates": list(dict.fromkeys(gates)), "constants": constants, "cyclic": False, "truncated": False, **more})

        def visit(node: str, hops: list[dict], passed: frozenset, gates: list[str]) -> None:
            nonlocal cut
            if len(found) >= MAX_PATHS:
                cut = True
                return
            branches = [(e, s) for e in self.incoming.get(node, ()) for s in (e["sources"] or [None])]
            if not branches:
                ends(node, hops, gates, [])
            for left, (e, source) in zip(range(len(branches) - 1, -1, -1), branches):
                way = [e, *hops]
                tested = gates + [f for c in e["conditions"] for f in c["fields"] or ()]
                if source is None or source == node or source in passed or len(way) >= MAX_DEPTH or self.stops_at(source):
                    cyclic = source is not None and (source == node or source in passed)
                    ends(source, way, tested, e["constants"], cyclic=cyclic, truncated=source is not None and not cyclic and len(way) >= MAX_DEPTH)
                    continue
                visit(source, way, passed | {node}, tested)
                if len(found) >= MAX_PATHS:
                    cut = cut or left > 0
                    return

        visit(start, [], frozenset(), [])
        self.known[start] = (found, cut)
        return found, cut


def _value(constant: str) -> str:
    body = constant[1:] if constant[:1].upper() in "XPBCZ" else constant
    return body[1:-1].replace("''", "'") if len(body) > 1 and body[0] == body[-1] == "'" else constant


def _walk_batches(batches):
    schema = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            owners = {f["key"]: f["owner"] for f in row["fields"] or ()}
            walker = Walker(row["edges"], set(row["read_only"] or ()), owners)
            reasons = {o["key"]: o["reasons"] for o in row["opaque"] or ()}
            starts = [(s, True) for s in row["sinks"] if s in walker.incoming]
            gates = dict.fromkeys(g for s, _ in starts for p in walker.routes(s)[0] for g in p["gates"])
            starts += [(g, False) for g in gates if not walker.stops_at(g) and g in walker.incoming]
            for start, is_sink in starts:
                found, cut = walker.routes(start)
                for at, p in enumerate(found):
                    touched = [e["target"] for e in p["hops"]] + ([p["origin"]] if p["origin"] else [])
                    hops = [{k: e[k] for k in ("target", "via", "activity", "proc", "line", "origin", "statement", "operators", "accumulates")} | {"tests": [c["test"] for c in e["conditions"]]} for e in p["hops"]]
                    out.append({
                        "program_id": row["program_id"], "sink": start, "is_sink": is_sink, "path_ord": at, "origin": p["origin"], "hops": hops, "constants": [_value(c) for c in p["constants"]],
                        "influenced_by": p["gates"], "opaque": list(dict.fromkeys(r for k in touched for r in reasons.get(k, ()))), "cyclic": p["cyclic"], "truncated": p["truncated"], "cut": cut,
                    })
        if schema is None:
            hop = pa.struct([("target", pa.string()), ("via", pa.string()), ("activity", pa.string()), ("proc", pa.string()), ("line", pa.int32()), ("origin", pa.string()), ("statement", pa.string()), ("operators", pa.list_(pa.string())), ("accumulates", pa.bool_()), ("tests", pa.list_(pa.string()))])
            texts = pa.list_(pa.string())
            schema = pa.schema([("program_id", pa.string()), ("sink", pa.string()), ("is_sink", pa.bool_()), ("path_ord", pa.int32()), ("origin", pa.string()), ("hops", pa.list_(hop)), ("constants", texts), ("influenced_by", texts), ("opaque", texts), ("cyclic", pa.bool_()), ("truncated", pa.bool_()), ("cut", pa.bool_())])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
