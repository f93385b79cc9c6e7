"""Curriculum trees: flatten, look up, validate, browse, search, edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import gates, similarity
from lectern.functions.words import strip
from lectern.operators import content_check, fuzzy
from lectern.operators.layout import spread_small, written
from lectern.sources.curriculum import CONCEPT, DEPTH, node_schema

_FLAT = f"array<struct<subtopic_path: array<string>, ord: array<int>, c: {CONCEPT}>>"
_TEXT = "array<struct<subtopic_path: array<string>, ord: array<int>, text: string>>"
_LEFT = "array<struct<path: string, text: string>>"
_NONE = "array<struct<path: string, rule: string, message: string>>"


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _down(path: Column, name: Column) -> Column:
    """The path of a subtopic; one without a name adds nothing."""
    return F.when(F.coalesce(name, F.lit("")) == "", path).otherwise(F.array_append(path, name))


def _concepts_below(node: Column, path: Column, ord_: Column, levels: int) -> Column:
    """All concepts of a node, its own first, then those of its subtopics in order."""
    own = F.transform(
        node["concepts"],
        lambda c, i: F.struct(path.alias("subtopic_path"), F.concat(ord_, F.array(F.lit(0), i)).alias("ord"), c.alias("c")),
    )
    own = _or_empty(own, _FLAT)
    if levels == 0:
        return own
    below = F.flatten(F.transform(
        node["subtopics"],
        lambda s, j: _concepts_below(s, _down(path, s["name"]), F.concat(ord_, F.array(F.lit(1), j)), levels - 1),
    ))
    return F.concat(own, _or_empty(below, _FLAT))


def _texts_below(node: Column, path: Column, ord_: Column, levels: int) -> Column:
    """The subtopics that lie deeper than the schema reads: still JSON text."""
    if levels == 0:
        found = F.transform(
            node["subtopics"],
            lambda s, j: F.struct(path.alias("subtopic_path"), F.concat(ord_, F.array(F.lit(1), j)).alias("ord"), s.alias("text")),
        )
    else:
        found = F.flatten(F.transform(
            node["subtopics"],
            lambda s, j: _texts_below(s, _down(path, s["name"]), F.concat(ord_, F.array(F.lit(1), j)), levels - 1),
        ))
    return _or_empty(found, _TEXT)


def flatten_concepts(subjects: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per concept, depth first, topic-level concepts before subtopics, however deep they lie.

    ``ord`` compares like the position in the tree: topic, then (0, concept) or
    (1, subtopic) pairs down the path. ``depth`` is how many levels the schema of
    ``topics`` reads at once; subtopics below are kept as text, parsed as nodes of the
    same schema, and so on until none has subtopics left.
    """
    cols = [c for c in subjects.columns if c != "topics"]
    nodes = subjects.select(*cols, F.posexplode("topics").alias("_t", "_node")).select(
        *cols, F.col("_node.name").alias("topic"), F.array().cast("array<string>").alias("_path"), F.array("_t").alias("_ord"), "_node",
    )
    flat = None
    while True:
        here = (F.col("_node"), F.col("_path"), F.col("_ord"), depth)
        rows = nodes.select(*cols, "topic", F.explode(_concepts_below(*here)).alias("r")).select(
            *cols, "topic", "r.subtopic_path", "r.ord",
            F.col("r.c.name").alias("concept"), "r.c.summary", "r.c.steps", "r.c.questions",
        )
        flat = rows if flat is None else flat.unionByName(rows)
        deeper = written(nodes.select(*cols, "topic", F.explode(_texts_below(*here)).alias("r")).select(*cols, "topic", "r.*"), "deeper")
        if not deeper.limit(1).count():
            return flat
        parsed = F.explode(F.array(F.from_json("text", node_schema(depth)))).alias("_node")
        nodes = deeper.select(*cols, "topic", "subtopic_path", F.col("ord").alias("_ord"), parsed).withColumn(
            "_path", _down(F.col("subtopic_path"), F.col("_node.name"))
        ).drop("subtopic_path")


def flatten_questions(concepts: DataFrame) -> DataFrame:
    """D1a at question level; a concept without questions keeps one row."""
    cols = [c for c in concepts.columns if c != "questions"]
    return concepts.select(*cols, F.posexplode_outer("questions").alias("question_no", "q")).select(
        *cols, "question_no", "q.question", "q.acceptable_answers", "q.hints"
    )


def lookup_concepts(concepts: DataFrame, requests: DataFrame) -> DataFrame:
    """The first concept of that name for each (subject, topic, concept) asked."""
    keys = ["subject", "topic", "concept"]
    hits = concepts.join(requests.select(*keys).distinct(), keys)
    rest = [c for c in concepts.columns if c not in keys]
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*")


def lookup_question(concepts: DataFrame, requests: DataFrame) -> DataFrame:
    """The question at ``question_no`` of each concept asked."""
    found = lookup_concepts(concepts, requests)
    asked = requests.select("subject", "topic", "concept", "question_no")
    at = F.get("questions", F.col("question_no"))
    return found.join(asked, ["subject", "topic", "concept"]).select(
        "subject", "topic", "concept", "question_no", at["question"].alias("question")
    ).where(F.col("question").isNotNull())


def concepts_at_path(concepts: DataFrame, subject: str, topic: str, path: list[str] = ()) -> DataFrame:
    """Concepts at or below a subtopic path."""
    hit = (F.col("subject") == subject) & (F.col("topic") == topic)
    if path:
        hit = hit & (F.slice("subtopic_path", 1, len(path)) == F.array(*[F.lit(p) for p in path]))
    return concepts.where(hit)


def concepts_below_paths(concepts: DataFrame, requests: DataFrame) -> DataFrame:
    """P15 for a table of requests (request_id, subject, topic, path)."""
    listed = concepts.withColumn(
        "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("subtopic_path")), lambda n: F.slice("subtopic_path", F.lit(1), n)))
    )
    return requests.join(listed, ["subject", "topic", "path"])


def browse_entries(concepts: DataFrame) -> DataFrame:
    """A17 + F36: each topic and subtopic path that holds a concept, labelled ``topic > a > b``."""
    prefix = F.transform(F.sequence(F.lit(0), F.size("subtopic_path")), lambda n: F.slice("subtopic_path", F.lit(1), n))
    return (
        concepts.select("subject", "topic", "ord", F.explode(prefix).alias("path"))
        .groupBy("subject", "topic", "path").agg(F.min("ord").alias("first"))
        .withColumn("label", F.concat_ws(" > ", F.col("topic"), F.col("path")))
    )


def structure_profile(subjects: DataFrame) -> DataFrame:
    """Per subject and topic the number of direct concepts and subtopics."""
    cols = [c for c in subjects.columns if c != "topics"]
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return subjects.select(*cols, size(F.col("topics")).alias("topics"), F.posexplode("topics").alias("topic_no", "t")).select(
        *cols, "topics", "topic_no", F.col("t.name").alias("topic"),
        size(F.col("t.concepts")).alias("direct_concepts"), size(F.col("t.subtopics")).alias("subtopics"),
    )


# --- validation -------------------------------------------------------------


def missing_fields(node: Column, required: list[str]) -> Column:
    """P21 + U5: required names less the names that are present."""
    present = F.array_compact(F.array(*[F.when(node[f].isNotNull(), F.lit(f)) for f in required]))
    return F.array_except(F.array(*[F.lit(f) for f in required]), present)


def _breach(path: Column, rule: str, broken: Column, message: Column) -> Column:
    one = F.struct(path.alias("path"), F.lit(rule).alias("rule"), message.alias("message"))
    return F.when(F.coalesce(broken, F.lit(False)), F.array(one)).otherwise(F.array().cast(_NONE))


def _missing(node: Column, path: Column, kind: str) -> Column:
    gone = missing_fields(node, lexicon.REQUIRED_FIELDS[kind])
    message = F.concat(F.lit("lacks "), F.array_join(gone, ", "))
    return _breach(path, f"{kind}_fields", F.size(gone) > 0, message)


def _blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def _blank_items(items: Column, path: Column, rule: str, noun: str) -> Column:
    numbered = F.transform(
        items,
        lambda s, i: F.when(
            s.isNull() | _blank(s),
            F.struct(
                path.alias("path"), F.lit(rule).alias("rule"),
                F.concat(F.lit(noun + " "), (i + 1).cast("string"), F.lit(" is blank")).alias("message"),
            ),
        ),
    )
    return _or_empty(F.array_compact(numbered), _NONE)


def _below(items: Column, check) -> Column:
    return _or_empty(F.flatten(F.transform(items, check)), _NONE)


def _named(path: Column, noun: str, name: Column) -> Column:
    return F.concat(path, F.lit(f" > {noun} '"), F.coalesce(name, F.lit("unknown")), F.lit("'"))


def _check_question(q: Column, path: Column) -> Column:
    return F.concat(
        _missing(q, path, "question"),
        _breach(path, "question_text", _blank(q["question"]), F.lit("question is blank")),
        _breach(path, "answers_empty", F.size(q["acceptable_answers"]) == 0, F.lit("no accepted answer")),
        _blank_items(q["acceptable_answers"], path, "answer_text", "Answer"),
        _breach(path, "hints_empty", F.size(q["hints"]) == 0, F.lit("no hint")),
        _blank_items(q["hints"], path, "hint_text", "Hint"),
    )


def _check_concept(c: Column, parent: Column) -> Column:
    path = _named(parent, "Concept", c["name"])
    return F.concat(
        _missing(c, path, "concept"),
        _breach(path, "concept_name", _blank(c["name"]), F.lit("name is blank")),
        _breach(path, "concept_summary", _blank(c["summary"]), F.lit("summary is blank")),
        _breach(path, "steps_empty", F.size(c["steps"]) == 0, F.lit("no step")),
        _blank_items(c["steps"], path, "step_text", "Step"),
        _below(c["questions"], lambda q, i: _check_question(
            q, F.concat(path, F.lit(" > Question "), (i + 1).cast("string")))),
    )


def _check_subtopic(s: Column, parent: Column, levels: int) -> Column:
    path = _named(parent, "Subtopic", s["name"])
    rules = [
        _breach(path, "subtopic_name", s["name"].isNull() | _blank(s["name"]), F.lit("name is absent or blank")),
        _breach(path, "subtopic_content", s["concepts"].isNull() & s["subtopics"].isNull(),
                F.lit("holds neither concepts nor subtopics")),
        _below(s["concepts"], lambda c: _check_concept(c, path)),
    ]
    if levels:
        rules.append(_below(s["subtopics"], lambda n: _check_subtopic(n, path, levels - 1)))
    return F.concat(*rules)


def _deeper(s: Column, parent: Column, levels: int) -> Column:
    """The subtopics below the levels that were parsed, as JSON text with the path of what holds them."""
    path = _named(parent, "Subtopic", s["name"])
    if levels:
        return _or_empty(F.flatten(F.transform(s["subtopics"], lambda n: _deeper(n, path, levels - 1))), _LEFT)
    return _or_empty(F.transform(s["subtopics"], lambda t: F.struct(path.alias("path"), t.alias("text"))), _LEFT)


def violations(subjects: DataFrame, allowed: list[str] = lexicon.SUBJECTS, depth: int = DEPTH) -> DataFrame:
    """P20: every broken rule as a row (path, rule, message); loading itself stays lenient."""
    root = F.coalesce("subject", F.lit("unknown"))
    content = F.struct("subject", "grade", "topics")
    grade = F.col("grade").try_cast("int")
    topics = _below(
        F.col("topics"),
        lambda t: F.concat(
            _missing(t, _named(root, "Topic", t["name"]), "topic"),
            _breach(_named(root, "Topic", t["name"]), "topic_name", _blank(t["name"]), F.lit("name is blank")),
            _below(t["concepts"], lambda c: _check_concept(c, _named(root, "Topic", t["name"]))),
            _below(t["subtopics"], lambda s: _check_subtopic(s, _named(root, "Topic", t["name"]), depth - 1)),
        ),
    )
    every = F.concat(
        _missing(content, root, "content"),
        _breach(root, "subject", ~F.col("subject").isin(allowed),
                F.concat(F.lit("unknown subject "), F.coalesce("subject", F.lit("")))),
        _breach(root, "grade", F.col("grade").isNotNull() & ~F.coalesce(grade.between(1, 12), F.lit(False)),
                F.concat(F.lit("grade is not 1 to 12: "), F.coalesce("grade", F.lit("")))),
        topics,
    )
    cols = [c for c in subjects.columns if c not in ("topics", "path")]
    # What lies deeper than was parsed is walked level by level.
    left = _or_empty(F.flatten(F.transform(
        F.col("topics"), lambda t: _or_empty(F.flatten(F.transform(t["subtopics"], lambda s: _deeper(s, _named(root, "Topic", t["name"]), depth - 1))), _LEFT),
    )), _LEFT)
    # Both come from one pass over the content, told apart by the rule.
    none = F.lit(None).cast("string")
    both = F.concat(
        F.transform(every, lambda v: F.struct(v["path"].alias("path"), v["rule"].alias("rule"), v["message"].alias("message"), none.alias("text"))),
        F.transform(left, lambda d: F.struct(d["path"].alias("path"), none.alias("rule"), none.alias("message"), d["text"].alias("text"))),
    )
    rows = written(subjects.select(*cols, F.explode(both).alias("v")).select(*cols, "v.*"), "violations")
    found = rows.where("rule IS NOT NULL").drop("text")
    deep = rows.where("rule IS NULL").select(*cols, F.lit("subtopic").alias("kind"), "path", "text")
    if not deep.limit(1).count():
        return found
    node = F.try_parse_json("text")
    named = F.concat("path", F.lit(" > Subtopic '"), F.coalesce(F.try_variant_get(node, "$.name", "string"), F.lit("unknown")), F.lit("'"))
    nodes = deep.where(node.isNotNull()).select(*cols, "kind", named.alias("path"), node.alias("node"))
    return found.unionByName(content_check.walk(nodes, allowed))


# --- search -----------------------------------------------------------------


def search(
    concepts: DataFrame, queries: DataFrame, max_results: int = 3, ratio: float | None = lexicon.SEARCH_RATIO, **limits
) -> DataFrame:
    """J5 + T6: the first matches of each query in tree order.

    A concept matches when a name, summary, step, question or answer has a
    similarity over ``ratio`` with the query, or holds all its words. An empty
    query matches nothing. ``queries``: query_id, query. Equal queries and equal texts are compared once.
    """
    texts = F.concat(
        F.array("concept", "summary"), F.coalesce("steps", F.array().cast("array<string>")),
        F.flatten(F.transform(
            F.coalesce("questions", F.array()),
            lambda q: F.concat(F.array(q["question"]), F.coalesce(q["acceptable_answers"], F.array().cast("array<string>"))),
        )),
    )
    held = concepts.select("subject", "ord", F.explode(F.array_distinct(F.transform(F.array_compact(texts), F.lower))).alias("text"))
    # A text leads to its first concepts in tree order; one further on cannot be among a query's first.
    first = Window.partitionBy("text").orderBy("subject", "ord")
    held = held.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_results).drop("_n")
    held = written(held, "search-texts")
    asked = written(queries.select("query_id", F.lower("query").alias("query")).where("query IS NOT NULL"), "search-queries")
    each, different = asked.select("query").where(strip(F.col("query")) != "").distinct(), held.select("text").distinct()
    pairs = fuzzy.word_hits(each, different)
    if ratio is not None:
        pairs = pairs.unionByName(fuzzy.ratio_hits(each, different, ratio, **limits))
    pairs = written(pairs.distinct(), "search-pairs")
    hits = asked.join(pairs, "query").join(held, "text").select("query_id", "subject", "ord").distinct()
    order = Window.partitionBy("query_id").orderBy("subject", "ord")
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_results)
    found = written(best, "search")
    return concepts.select("subject", "ord", "topic", "concept", "summary").join(found, ["subject", "ord"])


def relevant_sentence(df: DataFrame, keys: list[str], summary: str, question: str) -> DataFrame:
    """The sentence most like the question, the first of equals."""
    sentences = df.select(*keys, F.lower(question).alias("_q"), F.posexplode(F.split(summary, r"\. ")).alias("_n", "sentence"))
    scored = spread_small(sentences).withColumn("ratio", similarity.similarity_ratio(F.lower("sentence"), F.col("_q")))
    best = F.max_by(F.struct("sentence", "ratio"), F.struct(F.col("ratio"), -F.col("_n")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


# --- edits ------------------------------------------------------------------

EDIT_KEYS = {
    "topic": ["subject", "topic"],
    "concept": ["subject", "topic", "subtopic", "concept"],
    "question": ["subject", "topic", "subtopic", "concept", "question"],
}


def apply_edits(rows: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removals, then additions, on question rows; returns (new rows, effect per edit).

    ``rows``: subject, topic, subtopic, concept, question, where subtopic is the
    last name of the path, or the topic itself. ``edits``: edit_id, action (add
    or remove), level (topic, concept or question), the same names, payload.
    An addition needs its parent to exist and its payload to fit (P13).
    """
    cols = EDIT_KEYS["question"]
    kept, effects = rows.select(*cols), []
    for level, keys in EDIT_KEYS.items():
        gone = edits.where((F.col("action") == "remove") & (F.col("level") == level)).select("edit_id", *keys)
        found = gone.join(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left")
        effects.append(found.select("edit_id", F.coalesce("n", F.lit(0)).alias("rows")))
        kept = kept.join(gone.select(*keys).distinct(), keys, "left_anti").select(*cols)
    parents = {"topic": ["subject"], "concept": ["subject", "topic", "subtopic"],
               "question": ["subject", "topic", "subtopic", "concept"]}
    for level, keys in parents.items():
        new = edits.where((F.col("action") == "add") & (F.col("level") == level))
        fits = gates.payload_fits(F.coalesce("payload", F.lit("")))
        home = kept.select(*keys).distinct().withColumn("_home", F.lit(True))
        judged = new.join(home, keys, "left").withColumn("ok", fits & F.coalesce("_home", F.lit(False)))
        effects.append(judged.select("edit_id", F.col("ok").cast("long").alias("rows")))
        kept = kept.unionByName(judged.where("ok").select(*cols))
    total = effects[0]
    for part in effects[1:]:
        total = total.unionByName(part)
    return kept, total.select("edit_id", "rows", (F.col("rows") > 0).alias("changed"))


def with_content_version(content: DataFrame) -> DataFrame:
    """The backup stamp of a version, from its timestamp."""
    return content.withColumn("version", F.date_format("version_ts", "yyyyMMdd_HHmmss"))
