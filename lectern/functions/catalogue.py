"""Keyword catalogue columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions.words import strip


def key_terms(text: Column, limit: int = 5) -> Column:
    """the first plain lower-case words of three letters and more, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in lexicon.TITLE_STOPWORDS])
    return F.slice(F.filter(found, lambda w: ~F.array_contains(stop, w)), 1, limit)


def with_keywords(keywords: Column, title: Column, kind: Column) -> Column:
    """given keywords, or the title's terms and the type when there are none."""
    made = F.array_compact(F.array_append(key_terms(title), kind))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, keywords).otherwise(made)


def components_of(kind: Column, components: Column, children: Column) -> Column:
    """a structure without components uses its children."""
    return F.when((kind == "structure") & components.isNull(), children).otherwise(components)


def entry_terms(keywords: Column, title: Column) -> Column:
    """The lower-case keywords and the title's terms as one set."""
    return F.array_union(F.transform(keywords, lambda k: F.lower(k)), key_terms(title))


def overlap_score(matches: Column, asked: Column) -> Column:
    """share of the question's terms, a tenth more from two matches on, at most one."""
    share = matches / asked
    return F.when(matches == 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(matches >= 2, share * 1.1).otherwise(share)))


def trigger_key(text: Column, table=lexicon.TRIGGER_WORDS) -> Column:
    """The key of the first trigger word contained in the text."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(word), F.lit(key)) for word, key in table])


def _is_object(item: Column) -> Column:
    return item.startswith("{")


def _fields(item: Column) -> Column:
    return F.from_json(item, "map<string,string>")


def _name(item: Column) -> Column:
    return F.get_json_object(item, "$.name")


def clean_steps(steps: Column) -> Column:
    """step texts without a trailing parenthesis, 30 characters at most.

    Items are plain text or JSON objects; an object shows its name or first key.
    """
    plain = lambda s: strip(F.regexp_replace(s, r"(?U)\s*\([^)]+\)\s*$", ""))
    return F.transform(
        steps,
        lambda s: F.substring(
            F.when(_is_object(s), F.coalesce(_name(s), F.get(F.map_keys(_fields(s)), F.lit(0)), F.lit("Step"))).otherwise(plain(s)),
            1, 30,
        ),
    )


def child_names(children: Column, limit: int = 8) -> Column:
    """names of children; an unnamed object gives its first key that is not a detail."""
    first = lambda c: F.get(
        F.filter(F.map_keys(_fields(c)), lambda k: ~k.isin("children", "description")), F.lit(0)
    )
    names = F.transform(children, lambda c: F.when(_is_object(c), F.coalesce(F.nullif(_name(c), F.lit("")), first(c))).otherwise(c))
    return F.slice(F.array_compact(names), 1, limit)


def component_names(components: Column, limit: int = 8) -> Column:
    names = F.transform(components, lambda c: F.when(_is_object(c), F.nullif(_name(c), F.lit(""))).otherwise(c))
    return F.slice(F.array_compact(names), 1, limit)


def template_of(concept_type: Column) -> Column:
    """F38"""
    table = F.create_map(*[F.lit(x) for kv in lexicon.CONCEPT_TEMPLATES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(concept_type)), F.lit(lexicon.DEFAULT_TEMPLATE))


def is_concept_type(concept_type: Column) -> Column:
    return F.upper(concept_type).isin(*lexicon.CONCEPT_TEMPLATES)
