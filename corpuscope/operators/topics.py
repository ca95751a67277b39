"""Topic choice per document and its consolidation over the corpus."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import python_fold
from ..rulepack import PENDING, RulePack

#: Bits of a keyword's place in its topic's list; more than a rule pack needs.
_PLACE_BITS = 16


def _is_word(keyword: str) -> bool:
    return keyword.isascii() and keyword.isalnum()


def _sql_array(values) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def _literals(values) -> Column:
    """Constant string array, built in one call."""
    return F.expr(_sql_array(values)).cast("array<string>")


def _places_of(words: list[list[str]], phrases: list[list[str]]) -> Column:
    """Constant map: a collected keyword to the places (topic number and place in its list, as
    one number) of the keywords that occur where it does: a word itself, and all phrases in it."""
    lists = [[(w, w) for w in dict.fromkeys(ws)] + [(None, k) for k in ks] for ws, ks in zip(words, phrases)]
    entries = []
    for seen in sorted({key for ks in lists for _, key in ks}):
        places = [
            (topic << _PLACE_BITS) + i
            for topic, ks in enumerate(lists)
            for i, (word, key) in enumerate(ks)
            if (seen == word if word else key in seen)
        ]
        entries.append((seen, places))
    keys = _literals([seen for seen, _ in entries])
    values = F.expr("array(" + ", ".join(f"array({', '.join(map(str, p))})" for _, p in entries) + ")")
    return F.map_from_arrays(keys, values.cast("array<array<int>>"))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, even where ``body`` uses it
    inside nested lambdas (the optimizer would otherwise inline it there)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyword_match(folded: Column, keyword: str) -> Column:
    """Folded keyword in folded text; ASCII words need non-alphanumeric borders."""
    key = python_fold(keyword)
    if _is_word(key):
        return folded.rlike(f"(?<![a-z0-9]){key}(?![a-z0-9])")
    return folded.contains(key)


def _split_keywords(pack: RulePack) -> tuple[list[list[str]], list[list[str]]]:
    folded = [[python_fold(k) for k in t.keywords] for t in pack.topics]
    words = [[k for k in ks if _is_word(k)] for ks in folded]
    phrases = [[k for k in ks if not _is_word(k)] for ks in folded]
    return words, phrases


def _keyword_pattern(words: list[str], phrases: list[str]) -> str:
    """Zero-width pattern whose group is the longest keyword starting there. A test
    of the first character guards each list, so most positions cost one range test.
    No phrase may start with a letter or digit a word could start with."""
    options = []
    if words:
        firsts = "".join(sorted({w[0] for w in words}))
        options.append(f"(?=[{firsts}])(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")
    ordered = sorted(phrases, key=lambda k: (-len(k), k))
    cjk = [k for k in ordered if _is_ideographic(k)]
    if cjk:
        options.append(rf"(?=[\x{{3400}}-\x{{9fff}}&&{_one_of({k[0] for k in cjk})}])(?:{'|'.join(map(re.escape, cjk))})")
    options += [re.escape(k) for k in ordered if not _is_ideographic(k)]
    return f"(?=({'|'.join(options)}))"


def _is_ideographic(phrase: str) -> bool:
    return "㐀" <= phrase[0] <= "鿿"


def _one_of(chars: set[str], step: int = 8) -> str:
    """Class of the characters. The engine tests a class's members one after the other, so
    each few of them stand behind the range they span."""
    ordered = sorted(chars)
    parts = [ordered[i : i + step] for i in range(0, len(ordered), step)]
    return "[" + "".join(f"[{p[0]}-{p[-1]}&&[{''.join(p)}]]" for p in parts) + "]"


def _word_pattern(words: list[str]) -> str:
    """Group 1 is the word that starts at a match. Tests of one or two characters leave most
    positions: what precedes and follows is looked at from behind the first letters. No word
    starts at the second of them, as the first precedes it."""
    taken = min(2, *map(len, words))
    start = "".join("[" + "".join(sorted({w[i] for w in words})) + "]" for i in range(taken))
    # Single characters make one table of a class, ranges a call for each.
    border = f"[{string.ascii_lowercase}{string.digits}]"
    return f"{start}(?<!{border}{start})(?<=(?=({'|'.join(words)})(?!{border})){start})"


def _phrase_pattern(phrases: list[str]) -> str:
    """Group 1 is the longest of the ideographic phrases that starts at a match; one test of
    a character leaves most positions, as with words."""
    first = rf"[\x{{3400}}-\x{{9fff}}&&{_one_of({k[0] for k in phrases})}]"
    ordered = sorted(phrases, key=lambda k: (-len(k), k))
    return f"{first}(?<=(?=({'|'.join(map(re.escape, ordered))})){first})"


def keyword_hits(folded: Column, pack: RulePack, rest: Column | None = None) -> Column:
    """``ARRAY<INT>``: per topic, how many of its keywords occur in the text. With
    ``rest``, the residue (or far residue) of a text that folds without new ideographs, words
    and phrases are looked for apart, and phrases of ideographs only in texts that have some.

    One scan collects, at every position, the longest keyword that starts there; a
    second one, if the pack has any, the phrases that start like a word, so that a word
    and a phrase at one place are both seen. A keyword occurs exactly if one of the
    collected ones contains it; which ones each contains is looked up in a constant map."""
    words, phrases = _split_keywords(pack)
    all_words = sorted({k for ks in words for k in ks})
    all_phrases = sorted({k for ks in phrases for k in ks})
    wordlike = [k for k in all_phrases if re.match("[a-z0-9]", k)]
    others = [k for k in all_phrases if k not in wordlike]

    def scan(pattern: str) -> Column:
        return F.regexp_extract_all(folded, F.lit(pattern), F.lit(1))

    if rest is None:
        hits = [scan(_keyword_pattern(*s)) for s in ((all_words, others), ([], wordlike)) if any(s)]
    else:
        hits = [scan(_word_pattern(all_words))] if all_words else []
        hits += [scan(_keyword_pattern([], wordlike))] if wordlike else []
        if others and all(map(_is_ideographic, others)):
            none = F.array().cast("array<string>")
            hits.append(F.when(rest.rlike(r"[\x{3400}-\x{9fff}]"), scan(_phrase_pattern(others))).otherwise(none))
        elif others:
            hits.append(scan(_keyword_pattern([], others)))
    found = F.array_distinct(F.concat(*hits) if hits else F.array().cast("array<string>"))

    places = _places_of(words, phrases)
    occurring = F.array_distinct(F.flatten(F.transform(found, lambda s: F.element_at(places, s))))
    numbers = F.array(*[F.lit(i) for i in range(len(words))]).cast("array<int>")

    def count(seen: Column) -> Column:
        return F.transform(
            numbers, lambda topic: F.size(F.filter(seen, lambda place: F.shiftright(place, _PLACE_BITS) == topic))
        )

    return _bind(occurring, count)


def anchor_of(root: Column, folded_root: Column, parts: Column, pack: RulePack) -> Column:
    """Root folder name, or the first folder below it when the root is generic."""
    first = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))
    generic = folded_root.isin(*[python_fold(g) for g in pack.generic_folders])
    return F.when(generic, first).otherwise(root)


def folder_text(folded_folders: Column, pack: RulePack) -> Column:
    generic = _literals([python_fold(g) for g in pack.generic_folders])
    return F.array_join(F.filter(folded_folders, lambda f: ~F.array_contains(generic, f)), " ")


def with_topic_scores(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Adds ``scores`` (``ARRAY<INT>`` in pack order) from the folded names and the
    body's hits."""
    a, f, s = (keyword_hits(F.col(n), pack) for n in ("folded_anchor", "folder_text", "folded_stem"))
    weighted = F.transform(
        F.arrays_zip(a.alias("a"), f.alias("f"), s.alias("s"), F.col("body_hits").alias("b")),
        lambda z: z["a"] * pack.anchor_weight
        + z["f"] * pack.folder_weight
        + z["s"] * pack.stem_weight
        + F.least(z["b"], F.lit(pack.body_cap)),
    )
    return docs.withColumn("scores", weighted)


def with_topic_choice(docs: DataFrame, pack: RulePack) -> DataFrame:
    """``scores`` to ``topic``: the best one (ties by name), or pending when it is
    weak, or tied and not strong."""
    names = [t.name for t in pack.topics]
    ordered = sorted(names)
    order = F.expr("array(" + ", ".join(str(-ordered.index(n)) for n in names) + ")")
    ranked = F.sort_array(
        F.transform(F.col("scores"), lambda s, i: F.struct(s.alias("score"), F.get(order, i).alias("o"))),
        asc=False,
    )
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))["score"]
    weak = best["score"] < pack.min_topic_score
    tied = F.coalesce((best["score"] == second) & (best["score"] < pack.min_tied_score), F.lit(False))
    topic = F.when(weak | tied, F.lit(PENDING)).otherwise(F.get(_literals(ordered), -best["o"]))
    return docs.withColumn("ranked", ranked).withColumn("topic", topic).drop("scores", "ranked")


def specialise_topic(topic: Column, folded_anchor: Column, pack: RulePack) -> Column:
    out = F.when(topic != pack.special_base, topic)
    for keyword, special in pack.special_topics:
        out = out.when(keyword_match(folded_anchor, keyword), F.lit(special.name))
    return out.otherwise(topic)


def topic_counts(docs: DataFrame) -> DataFrame:
    """(topic, n, first): one row per topic name of the rule pack, so tiny."""
    return docs.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("path_key", "name_key", "doc_id")).alias("first"),
    )


def absorb_tiny_topics(counts: DataFrame, pack: RulePack) -> DataFrame:
    """Adds ``absorbed``: where each topic goes when one topic dominates.

    Windows run over the per-topic counts (at most one row per topic)."""
    whole = Window.partitionBy(F.lit(0))
    official = F.when(F.col("topic") != PENDING, F.col("n"))
    total = F.sum(official).over(whole)
    lead = F.max(
        F.when(F.col("topic") != PENDING, F.struct("n", "topic"))
    ).over(whole)
    tiny = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(pack.tiny_share)))
    moved = (
        (F.col("total") >= pack.absorb_min_total)
        & (F.col("lead.n") / F.col("total") >= F.lit(pack.absorb_share))
        & (F.col("topic") != PENDING)
        & (F.col("n") <= tiny)
        & (F.col("topic") != F.col("lead.topic"))
    )
    return (
        counts.withColumn("total", total)
        .withColumn("lead", lead)
        .withColumn(
            "absorbed",
            F.when(F.coalesce(moved, F.lit(False)), F.col("lead.topic")).otherwise(F.col("topic")),
        )
        .drop("total", "lead")
    )


def cap_topics(counts: DataFrame, pack: RulePack) -> DataFrame:
    """The ``max_topics`` largest topics after absorption; ties by first document."""
    return (
        counts.filter(F.col("absorbed") != PENDING)
        .groupBy("absorbed")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        .orderBy(F.desc("n"), "first")
        .limit(pack.max_topics)
    )


def final_topics(docs: DataFrame, pack: RulePack) -> DataFrame:
    """(topic, final_topic) for every topic in use; broadcastable by construction:
    it cannot have more rows than the rule pack has topics."""
    counts = absorb_tiny_topics(topic_counts(docs), pack)
    kept = cap_topics(counts, pack).select("absorbed", F.lit(True).alias("kept"))
    return counts.join(F.broadcast(kept), "absorbed", "left").select(
        "topic",
        F.when(F.col("kept"), F.col("absorbed")).otherwise(F.lit(PENDING)).alias("final_topic"),
    )


def assign_topics(docs: DataFrame, pack: RulePack, source: DataFrame | None = None) -> DataFrame:
    """Adds ``suggested_knowledge_base``, which the cap on topics governs, and keeps
    the document's own choice as ``chosen_topic``. ``source`` is a cheaper table with
    the same documents to count the topics on."""
    final = final_topics(docs if source is None else source, pack)
    return (
        docs.join(F.broadcast(final), "topic", "left")
        .withColumnRenamed("final_topic", "suggested_knowledge_base")
        .withColumnRenamed("topic", "chosen_topic")
    )


def moved_by_cap(records: DataFrame) -> DataFrame:
    """(chosen_topic, n): documents whose own topic is beyond the cap on topics."""
    moved = (F.col("suggested_knowledge_base") == PENDING) & (F.col("chosen_topic") != PENDING)
    return records.filter(moved).groupBy("chosen_topic").agg(F.count(F.lit(1)).alias("n"))
