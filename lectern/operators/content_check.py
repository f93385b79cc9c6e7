"""Curriculum content against its schema, as strictly as it is written and as deep as it goes.

Reading content with a fixed schema drops what the schema does not name and turns a value of the
wrong type into null. Here content stays a variant: a level of nodes is checked, its child nodes
are exploded into the next level, and that goes on until there are none. Every level is a table of its nodes, so neither
a deep nor a broad curriculum has to fit into one row of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions.words import strip
from lectern.operators.layout import written

NONE = "array<struct<rule: string, message: string>>"


def _found(rule: str, broken: Column, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    one = F.struct(F.lit(rule).alias("rule"), said.alias("message"))
    return F.when(F.coalesce(broken, F.lit(False)), F.array(one)).otherwise(F.array().cast(NONE))


def _type(value: Column) -> Column:
    """The JSON type of a variant; null where there is none."""
    name = F.schema_of_variant(value)
    return F.when(value.isNotNull(), (
        F.when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "object").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name == "BIGINT", "integer").otherwise("number")
    ))


def _field(node: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", kind)


def _check(kind: str, allowed: list[str]) -> Column:
    """Everything wrong with one node of a kind, fields of child nodes aside."""
    node, spec = F.col("node"), lexicon.CONTENT_SHAPE[kind]
    out, absent = [], []
    for name, (types, _) in spec.items():
        value = _field(node, name, "variant")
        known = _type(value)
        out.append(_found("wrong_type", ~known.isin(types.split(" or ")), F.concat(F.lit(f"{name} is "), known, F.lit(f", not {types}"))))
        if name in lexicon.REQUIRED_FIELDS.get(kind, ["name"]):
            absent.append(F.when(value.isNull(), F.lit(name)))
        text = F.when(known == "string", _field(node, name, "string"))
        if name in ("name", "summary", "question"):
            out.append(_found(f"{kind}_{'text' if name == kind else name}", strip(text) == "", f"{name} is blank"))
        if types == "list" and lexicon.CONTENT_SHAPE[kind][name][1] == "text":
            items = F.when(known == "list", _field(node, name, "array<variant>"))
            noun = {"steps": "step", "hints": "hint", "acceptable_answers": "answer"}[name]
            rule = {"acceptable_answers": "answers_empty"}.get(name, f"{name}_empty")
            out.append(_found(rule, F.size(items) == 0, f"no {noun}"))
            odd = F.filter(items, lambda v: _type(v) != "string")
            blank = F.filter(items, lambda v: (_type(v) == "string") & (strip(F.try_variant_get(v, "$", "string")) == ""))
            out.append(_found("wrong_type", F.size(odd) > 0, F.concat(F.size(odd).cast("string"), F.lit(f" of {name} not text"))))
            out.append(F.transform(F.coalesce(blank, F.array().cast("array<variant>")), lambda _: F.struct(F.lit(f"{noun}_text").alias("rule"), F.lit(f"{noun} is blank").alias("message"))))
    missing = F.array_compact(F.array(*absent)) if absent else F.array().cast("array<string>")
    out.append(_found(f"{kind}_fields", F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", "))))
    if kind == "subtopic":
        neither = _field(node, "concepts", "variant").isNull() & _field(node, "subtopics", "variant").isNull()
        out.append(_found("subtopic_content", neither, "holds neither concepts nor subtopics"))
    if kind == "content":
        subject, grade = _field(node, "subject", "string"), _field(node, "grade", "string")
        out.append(_found("subject", ~subject.isin(allowed), F.concat(F.lit("unknown subject "), subject)))
        out.append(_found("grade", ~grade.rlike("^(1[0-2]|[1-9])$"), F.concat(F.lit("grade is not 1 to 12: "), grade)))
    return F.when(_type(node) == "object", F.concat(*out)).otherwise(
        _found("wrong_type", F.lit(True), F.concat(F.lit("a node is "), _type(node), F.lit(", not object")))
    )


def _named(kind: str) -> Column:
    name = F.coalesce(_field(F.col("node"), "name", "string"), F.lit("unknown"))
    own = F.concat(F.lit("Question "), (F.col("pos") + 1).cast("string")) if kind == "question" else F.concat(F.lit(kind.capitalize() + " '"), name, F.lit("'"))
    return F.concat("path", F.lit(" > "), own)


def walk(nodes: DataFrame, allowed: list[str] = lexicon.SUBJECTS) -> DataFrame:
    """The columns of ``nodes`` besides kind and node, with rule and message: a row per violation of the nodes and all below them.

    ``nodes``: kind (content, topic, subtopic, concept or question), path (text) and node (variant), and any keys.
    """
    spark = nodes.sparkSession
    keys = [c for c in nodes.columns if c not in ("kind", "path", "node")]
    level, found = written(nodes, "nodes"), None
    while True:
        # Most levels hold a kind or two: only their rules are planned. No kinds, no nodes.
        kinds = {r["kind"] for r in level.select("kind").distinct().collect()}
        shape = {kind: spec for kind, spec in lexicon.CONTENT_SHAPE.items() if kind in kinds}
        if not shape:
            return level.select(*keys, "path", F.lit("").alias("rule"), F.lit("").alias("message")).limit(0) if found is None else found
        wrong = F.coalesce(*[F.when(F.col("kind") == kind, _check(kind, allowed)) for kind in shape])
        here = level.select(*keys, "path", F.explode(wrong).alias("v")).select(*keys, "path", "v.*")
        # A field that the schema does not name: only keys leave the node.
        fields = F.create_map(*[x for kind, spec in shape.items() for x in (F.lit(kind), F.array(*map(F.lit, spec)))])
        objects = level.where(_type(F.col("node")) == "object")
        named = spark.sql("SELECT n.*, e.key AS field FROM {objects} n, LATERAL variant_explode(n.node) e", objects=objects)
        odd = named.where(~F.array_contains(F.try_element_at(fields, F.col("kind")), F.col("field")))
        here = here.unionByName(odd.select(*keys, "path", F.lit("unknown_field").alias("rule"), F.concat(F.lit("field "), "field").alias("message")))
        found = here if found is None else found.unionByName(here)
        below = None
        for kind, spec in shape.items():
            for name, (types, child) in spec.items():
                if types != "list" or child == "text":
                    continue
                parents = objects.where(F.col("kind") == kind).select(*keys, "path", _field(F.col("node"), name, "variant").alias("list"))
                parents = parents.where(_type(F.col("list")) == "list")
                items = spark.sql("SELECT p.* EXCEPT (list), e.pos, e.value AS node FROM {parents} p, LATERAL variant_explode(p.list) e", parents=parents)
                items = items.select(*keys, F.lit(child).alias("kind"), _named(child).alias("path"), "node")
                below = items if below is None else below.unionByName(items)
        if below is None:  # questions alone hold no nodes
            return found
        level = written(below, "nodes")


def violations(files: DataFrame, allowed: list[str] = lexicon.SUBJECTS) -> DataFrame:
    """P20 + D1 on content as text: path, rule and message for everything wrong in ``value``; other columns of ``files`` are kept.

    Text that is not JSON is one violation, ``not_json``.
    """
    keys = [c for c in files.columns if c not in ("value", "path")]
    parsed = F.try_parse_json("value")
    root = F.coalesce(_field(parsed, "subject", "string"), F.lit("unknown"))
    bad = files.where(parsed.isNull()).select(*keys, F.lit("unknown").alias("path"), F.lit("not_json").alias("rule"), F.lit("content is not JSON").alias("message"))
    return walk(files.where(parsed.isNotNull()).select(*keys, F.lit("content").alias("kind"), root.alias("path"), parsed.alias("node")), allowed).unionByName(bad)
