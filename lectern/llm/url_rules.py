"""URL rules, carried over redirects and canonical links.

A rule is a host, a path prefix and a verdict; it fits the host and its subdomains,
and of the rules that fit a URL the longest decides. A page names other addresses of
itself by a canonical link, a meta refresh or a script that sets the location. These
edges join URLs into components (distributed connected components), and a page that
no rule fits takes the verdict of its aliases: allow if a rule allows one of them,
else block if a rule blocks one, else allow. A page's own rule always stands.

Rules meet URLs by a join on the suffixes of distinct hosts and paths, so a list of
any length works and a host that holds a third of all pages is looked up once per
path. Nodes are URLs without scheme and fragment.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits
no rule and has no aliases; a null page has no links; repeated rows and page ids are
kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
# How a page names another address of itself.
CANONICAL = (
    r"(?is)<link\s(?:[^>]*\s)?rel\s*=\s*"
    r"(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"[^>]*|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'[^>]*|canonical(?:[\s/][^>]*)?)>"
)
REFRESH = r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TO = r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
LOCATION = r"(?is)\blocation(?:\.href)?\s*(?:=|\.replace\(|\.assign\()\s*[\"']([^\"'\s>]+)[\"']"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``, the latter with the segment before."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.array_append(kept, part))

    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    plain = F.array_join(F.concat(F.aggregate(parts, none, step), ends), "/")
    return F.when(F.contains(path, F.lit("/.")), plain).otherwise(path)


def unescaped(text: Column) -> Column:
    """The text with its HTML entities resolved: those of XML, and numbers of printable ASCII."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(?:0*[0-9]{2,3}|x0*[0-9a-f]{2});"), 0))

    def resolve(done: Column, mark: Column) -> Column:
        digits = F.regexp_extract(mark, "(?i)#x?([0-9a-f]+)", 1)
        code = F.conv(digits, 10, 10).cast("int")
        code = F.when(F.lower(mark).startswith("&#x"), F.conv(digits, 16, 10).cast("int")).otherwise(code)
        return F.when(code.between(33, 126), F.replace(done, mark, F.char(code))).otherwise(done)

    out = F.aggregate(marks, text, resolve)
    for name, letter in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def node_of(url: Column) -> Column:
    """Host, path without dot segments, and query; null where there is no host."""
    host = host_of(url)
    path = F.when(path_of(url) == "", "/").otherwise(without_dots(path_of(url)))
    return F.when(host != "", F.concat(host, path, F.coalesce(F.regexp_extract(url, SPLIT, 3), F.lit(""))))


def resolved(link: Column, url: Column) -> Column:
    """``link`` as it stands on the page ``url``."""
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?://)", 1), host_of(url)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(scheme, host, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(scheme, host, path_of(url), link))
        .otherwise(F.concat(scheme, host, F.when(folder == "", "/").otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that (url, html) says are one page."""
    links = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), 0), lambda t: unescaped(F.regexp_extract(t, HREF, 1))),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), 0), lambda t: unescaped(F.regexp_extract(t, REFRESH_TO, 1))),
        F.regexp_extract_all("html", F.lit(LOCATION), 1),
    )
    # Most pages have no such mark: they stop at one look for the words.
    told = pages.where("url LIKE '%://%'").where(F.col("html").rlike(r"(?i)canonical|refresh|location"))
    told = told.select("url", F.explode(links).alias("link")).where("link <> ''")
    edges = told.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("link"), F.col("url"))).alias("b"))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) that a rule fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct().withColumn("r_host", F.explode(F.array_distinct(suffixes)))
    known = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    fits = asked.join(known, "r_host").where(F.col("path").startswith(F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    # Of equally long rules the one with the longer host, then allow.
    best = F.max(F.struct(F.length(rule), F.length("r_host"), (F.col("r_verdict") == "allow"), rule.alias("rule"), F.col("r_verdict").alias("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of (page_id, url, html)."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = stored(matched(rows, rules), "rules")
    groups = stored(connected_components(alias_edges(pages)), "aliases")

    # What rules say of every node of a component, also of those that are no row of the table.
    address = F.concat(F.lit("x://"), F.col("node"))
    nodes = groups.select("node", "component", host_of(address).alias("host"), path_of(address).alias("path"))
    said = nodes.join(matched(nodes, rules), ["host", "path"])
    said = said.groupBy("component").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"))
    by_alias = stored(groups.join(said, "component").select(F.col("node").alias("n"), "allowed"), "verdicts")

    out = rows.join(own.select(F.col("host").alias("h"), F.col("path").alias("p"), "rule", "verdict"), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    out = out.join(by_alias, F.col("node") == F.col("n"), "left")
    verdict = F.coalesce("verdict", F.when(F.col("allowed") == 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {RULES} AS r(host, path, verdict)")
    return judge(spark.read.parquet(f"{folder}/pages.parquet"), rules)


_LINK_SQL = """
    CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
         WHEN link LIKE '//%' THEN 'x:' || link
         WHEN link LIKE '/%' THEN 'x://' || host || link
         WHEN link LIKE '?%' OR link LIKE '#%' THEN 'x://' || host || path || link
         ELSE 'x://' || host || CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || link END
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _plain_sql(path: str) -> str:
    """The path's segments taken one after another, as a list that ``..`` shortens."""
    walk = f"""list_reduce(list_prepend(CAST([] AS VARCHAR[]), [[p] FOR p IN string_split({path}, '/')]),
        lambda kept, p: CASE p[1] WHEN '.' THEN kept WHEN '..' THEN kept[:greatest(len(kept) - 1, 1)] ELSE list_append(kept, p[1]) END)"""
    return f"array_to_string({walk}, '/') || CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END"


def _told_sql(link: str) -> str:
    """Entities by a replacement for each printable letter."""
    numbers = f"""list_reduce(list_prepend({link}, [chr(c::INTEGER) FOR c IN range(33, 127)]), lambda t, c:
        regexp_replace(t, '&#(0*' || ascii(c) || '|[xX]0*' || lower(hex(ascii(c))) || '|[xX]0*' || hex(ascii(c)) || ');', CASE c WHEN chr(92) THEN '\\\\' ELSE c END, 'g'))"""
    for name, letter in ENTITIES.items():
        numbers = f"replace({numbers}, '&{name};', '{letter.replace(chr(39), chr(39) * 2)}')"
    return numbers


def _node_sql(url: str) -> str:
    host = f"translate(regexp_extract({url}, {_quoted(SPLIT)}, 1), '{UPPER}', '{LOWER}')"
    path = _plain_sql(f"regexp_extract({url}, {_quoted(SPLIT)}, 2)")
    return (
        f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
        f" || coalesce(regexp_extract({url}, {_quoted(SPLIT)}, 3), '') END"
    )


def _best_sql(of: str) -> str:
    return f"""
    SELECT host, path, arg_max(r_host || r_path, k) AS rule, arg_max(r_verdict, k) AS verdict
    FROM (SELECT host, path, r_host, r_path, r_verdict, (length(r_host || r_path), length(r_host), (r_verdict = 'allow')::INT) AS k
          FROM (SELECT DISTINCT host, path FROM {of}) u JOIN ({RULES}) r(r_host, r_path, r_verdict)
          ON (u.host = r_host OR u.host LIKE '%.' || r_host) AND starts_with(path, r_path)) GROUP BY host, path
    """


ORACLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, {_quoted(SPLIT)}, 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, {_quoted(SPLIT)}, 2), '') AS path, {_node_sql('url')} AS node FROM pages
), links AS (
  SELECT node, host, path, unnest(list_concat(list_concat(
    [{_told_sql(f"regexp_extract(t, {_quoted(HREF)}, 1)")} FOR t IN regexp_extract_all(html, {_quoted(CANONICAL)})],
    [{_told_sql(f"regexp_extract(t, {_quoted(REFRESH_TO)}, 1)")} FOR t IN regexp_extract_all(html, {_quoted(REFRESH)})]),
    regexp_extract_all(html, {_quoted(LOCATION)}, 1))) AS link
  FROM rows WHERE node IS NOT NULL
), edges AS (
  SELECT node AS a, {_node_sql('target')} AS b FROM (SELECT node, {_LINK_SQL} AS target FROM links WHERE link <> '')
), sides AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach(a, b) AS (
  SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a
), nodes AS (
  SELECT DISTINCT b AS node, translate(regexp_extract('x://' || b, {_quoted(SPLIT)}, 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract('x://' || b, {_quoted(SPLIT)}, 2) AS path FROM reach
), said AS (
  SELECT n.node, m.verdict FROM nodes n JOIN ({_best_sql('nodes')}) m USING (host, path)
), by_alias AS (
  SELECT a AS node, max((verdict = 'allow')::INT) AS allowed FROM reach JOIN said ON said.node = reach.b GROUP BY a
)
SELECT page_id, host, path, rule,
       coalesce(m.verdict, CASE WHEN allowed = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM rows LEFT JOIN ({_best_sql('rows')}) m USING (host, path) LEFT JOIN by_alias USING (node)
"""
