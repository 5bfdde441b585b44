"""Licence scans: Dice coefficients of word bigrams against templates, in column expressions only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.licence_texts import TEMPLATES

SIMILARITY = 0.8
_NOISE = r"[^\p{L}\p{N}\n]+"
_OWNER = r"(?m)^ *copyright (?:c )?[0-9]{4}[^\n]*$"
_GAP = r"\n(?: *\n)+"


def template_bigrams(text: str) -> Counter[str]:
    """Word bigrams of a template, with repeats, after the normalization that texts get."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return Counter(map(" ".join, zip(words, words[1:])))


def units(text: Column) -> Column:
    """``(unit, position, words)`` of lines, paragraphs of several lines, and a text of several paragraphs."""

    def unit(kind: str, position: Column, words: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), position.alias("position"), words.alias("words"))

    ends = F.lit(" \n")
    lines = F.transform(F.split(text, "\n"), lambda x, i: unit("line", i, F.split(F.trim(x), " ")))
    paragraphs = F.transform(
        F.filter(
            F.transform(F.split(text, _GAP), lambda x, i: F.struct(i.alias("i"), F.trim(x, ends).alias("x"))),
            lambda p: p["x"].contains("\n"),
        ),
        lambda p: unit("paragraph", p["i"], F.split(p["x"], "[ \n]+")),
    )
    none = F.array().cast("array<struct<unit:string,position:int,words:array<string>>>")
    inner = F.trim(text, ends)
    whole = F.when(inner.rlike(_GAP), F.array(unit("document", F.lit(0), F.split(inner, "[ \n]+")))).otherwise(none)
    return F.concat(lines, paragraphs, whole)


def licence_matches(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    templates: Sequence[tuple[str, str, str]] = TEMPLATES, similarity: float = SIMILARITY,
) -> DataFrame:
    """``(doc_id, unit, position, licence, form, dice)`` for every unit and its most similar template.

    A unit is a line, a paragraph of several lines or a text of several
    paragraphs, counted from 0.  The coefficient is twice the common bigrams
    over all bigrams of both, with repeats.  Sizes bound it: only templates of
    a size that can reach ``similarity`` are compared, and only units enough of
    whose bigrams occur in any template at all.  Ties go to the first licence
    and form by name.  Null, empty and one-word units match nothing; very long
    texts are cut into units and judged whole as well; repeated rows give
    repeated results; an empty table gives none; other columns play no part.
    """
    grams = [(name, form, template_bigrams(body)) for name, form, body in templates]
    ratio = similarity / (2 - similarity)
    sizes = [sum(g.values()) for _, _, g in grams]
    known = sorted({g for _, _, own in grams for g in own})
    low, high = min(sizes) * ratio - 1e-9, max(sizes) / ratio + 1e-9
    catalogue = F.array(*[
        F.struct(
            F.lit(name).alias("licence"), F.lit(form).alias("form"), F.lit(n).alias("size"),
            F.array(*[F.struct(F.lit(g).alias("gram"), F.lit(k).alias("n")) for g, k in sorted(own.items())]).alias("grams"),
        )
        for (name, form, own), n in zip(grams, sizes)
    ])
    # Lower-cased runs of letters and digits with one blank between, without copyright lines that name a year.
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.col(text).cast("string")), _NOISE, " "), _OWNER, "")

    def with_hits(u: Column) -> Column:
        words = u["words"]
        pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
        return F.struct(
            u["unit"].alias("unit"), u["position"].alias("position"), (F.size(words) - 1).alias("size"),
            F.filter(pairs, lambda g: g.isin(known)).alias("hits"),
        )

    # No template can match a unit outside these sizes, and a match shares at least ``ratio`` of the unit's bigrams.
    sized = F.filter(units(F.col("_t")), lambda u: (F.size(u["words"]) - 1).between(low, high))
    close = F.filter(F.transform(sized, with_hits), lambda u: F.size(u["hits"]) >= ratio * u["size"] - 1e-9)
    size, hits = F.col("_u.size"), F.col("_u.hits")

    def dice(t: Column) -> Column:
        common = F.aggregate(
            t["grams"], F.lit(0),
            lambda total, g: total + F.least(g["n"], F.size(F.filter(hits, lambda h: h == g["gram"]))),
        )
        return 2.0 * common / (t["size"] + size)

    fitting = F.filter(catalogue, lambda t: (t["size"] >= ratio * size - 1e-9) & (ratio * t["size"] <= size + 1e-9))
    scored = F.transform(fitting, lambda t: F.struct((-dice(t)).alias("cost"), t["licence"].alias("licence"), t["form"].alias("form")))
    return (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), plain.alias("_t"))
        .select("doc_id", F.explode(close).alias("_u"))
        .select("doc_id", "_u.unit", "_u.position", F.explode(F.array(F.array_min(scored))).alias("_b"))
        .select("doc_id", "unit", "position", "_b.licence", "_b.form", (-F.col("_b.cost")).alias("dice"))
        .where(F.col("dice") >= similarity - 1e-9)
    )


def sql(templates: Sequence[tuple[str, str, str]] = TEMPLATES, similarity: float = SIMILARITY) -> str:
    """The same result in SQL: all bigrams of all units joined with all bigrams of the templates."""
    rows = ", ".join(
        f"({k}, '{name}', '{form}', '{gram}', {n})"
        for k, (name, form, body) in enumerate(templates) for gram, n in sorted(template_bigrams(body).items())
    )
    return f"""
        WITH t(template, licence, form, gram, n) AS (VALUES {rows}),
        ts AS (SELECT template, licence, form, sum(n) AS size FROM t GROUP BY ALL),
        d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), '{_OWNER}', '', 'g') AS x
            FROM documents WHERE text IS NOT NULL
        ),
        u AS (
            SELECT r, doc_id, 'line' AS unit, i - 1 AS position, l[i] AS x
            FROM (SELECT r, doc_id, string_split(x, chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM d)
            UNION ALL
            SELECT r, doc_id, 'paragraph', i - 1, l[i]
            FROM (SELECT r, doc_id, string_split_regex(x, '{_GAP}') AS l, unnest(range(1, len(l) + 1)) AS i FROM d)
            WHERE contains(trim(l[i], ' ' || chr(10)), chr(10))
            UNION ALL
            SELECT r, doc_id, 'document', 0, x FROM d WHERE regexp_matches(trim(x, ' ' || chr(10)), '{_GAP}')
        ),
        w AS (SELECT r, doc_id, unit, position, list_filter(string_split_regex(x, '[ \\n]+'), lambda s: s <> '') AS w FROM u),
        g AS (
            SELECT r, doc_id, unit, position, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram
            FROM w WHERE len(w) > 1
        ),
        c AS (SELECT r, doc_id, unit, position, size, gram, count(*) AS n FROM g GROUP BY ALL),
        m AS (
            SELECT r, doc_id, unit, position, licence, form, 2.0 * sum(least(c.n, t.n)) / (any_value(c.size) + any_value(ts.size)) AS dice
            FROM c JOIN t USING (gram) JOIN ts USING (template, licence, form)
            GROUP BY r, doc_id, unit, position, template, licence, form
        )
        SELECT doc_id, unit, CAST(position AS INTEGER) AS position, licence, form, dice
        FROM m WHERE dice >= {similarity - 1e-9}
        QUALIFY row_number() OVER (PARTITION BY r, unit, position ORDER BY dice DESC, licence, form) = 1
    """


def op4(docs: DataFrame) -> DataFrame:
    return licence_matches(docs)
