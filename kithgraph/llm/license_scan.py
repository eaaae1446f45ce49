"""License scans by a positional index of rare words, in DataFrame operations only.

Templates are licence texts and names with mandatory key phrases (license_texts). The
index holds, for each template, the few of its words with the highest inverse document
frequency among the templates, and their places. A file's words that are in the index
are its highest-IDF licence words; each of their places, less the place in the template,
is a vote for where the template would begin. Votes within a template's tolerance agree,
so words may be put in or left out; where enough of a template's indexed words agree, its
key phrases are verified near their places. A name has no tolerance, all its indexed
words and it as a whole must stand. The score is the part of the indexed words that
agree, times how specific a template of that size is.

Everything is an expression on the text's own row: nothing is shuffled or joined, and a
text without a word of any key phrase is only counted.

Defined results: null and empty texts have no words, no places and no labels; copies and
repeated rows get equal results; an edited text may be found at several beginnings within
the tolerance; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.license_texts import NAMES, TEXTS

#: What is no part of a word, for texts in either case; one by one, which the JVM looks up in a table.
_GAP = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Indexed words of a template, and the part of them that must agree in a text.
INDEXED, LEAST = 12, 0.5
#: By how many words a text may be shifted against its template: at most this many, and at most a part of its size.
TOLERANCE, OF_SIZE = 24, 6
BASE = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False

    @cached_property
    def words(self) -> tuple[str, ...]:
        return tuple(re.findall(WORD, self.text.lower()))

    @cached_property
    def tolerance(self) -> int:
        return 0 if self.phrases == (self.text,) else min(TOLERANCE, len(self.words) // OF_SIZE)

    @cached_property
    def keys(self) -> tuple[tuple[int, int, str], ...]:
        """Place, size and words of each key phrase."""
        found = []
        for phrase in self.phrases:
            own = tuple(phrase.split())
            at = next(k for k in range(len(self.words)) if self.words[k : k + len(own)] == own)
            found.append((at, len(own), phrase))
        return tuple(found)

    @cached_property
    def specific(self) -> float:
        return 1 - 0.5 ** (len(self.words) / 4)


TEMPLATES = (*(Template(label, phrase, (phrase,), k < BASE) for k, (label, phrase) in enumerate(NAMES)), *(Template(label, text, phrases)
    for label, phrases, text in TEXTS))


@dataclass(frozen=True)
class Anchor:
    """An indexed word of a template."""

    template: int
    number: int
    at: int
    word: str


def frequencies(templates: tuple[Template, ...]) -> Counter:
    """In how many templates each word stands."""
    return Counter(w for t in templates for w in set(t.words))


def index_of(templates: tuple[Template, ...], most: int = INDEXED) -> list[Anchor]:
    """Each template's words of highest IDF, of those that stand in it once."""
    seen, out = frequencies(templates), []
    for n, t in enumerate(templates):
        once = [w for w, k in Counter(t.words).items() if k == 1]
        once.sort(key=lambda w: (-math.log(len(templates) / seen[w]), -len(w), w))
        out += [Anchor(n, k, t.words.index(w), w) for k, w in enumerate(once[:most])]
    return out


def needed(templates: tuple[Template, ...], index: list[Anchor]) -> list[int]:
    """How many indexed words must agree, by template."""
    n = Counter(a.template for a in index)
    return [n[k] if not t.tolerance else math.ceil(LEAST * n[k]) for k, t in enumerate(templates)]


def needles(templates: tuple[Template, ...], least: int = 6) -> tuple[list[str], list[str]]:
    """Words of which a text that holds a template must hold one, and phrases of templates without a word of so many letters.

    A text must have all words of a template's key phrases, so one is enough: the fewest
    words that cover all templates, taken one after the other.
    """
    open_ = {n: {w for _, _, p in t.keys for w in p.split() if len(w) >= least} for n, t in enumerate(templates)}
    phrases = sorted({templates[n].phrases[0] for n, words in open_.items() if not words})
    open_ = {n: words for n, words in open_.items() if words}
    chosen = []
    while open_:
        count = Counter(w for words in open_.values() for w in words)
        best = min(count, key=lambda w: (-count[w], -len(w), w))
        chosen.append(best)
        open_ = {n: words for n, words in open_.items() if best not in words}
    return sorted(chosen), phrases


def may_hold(text: Column, templates: tuple[Template, ...]) -> Column:
    """False only for texts that hold no template; lower case by Unicode maps A-Z as the scan does, and more."""
    words, phrases = needles(templates)
    lower = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | lower.contains(w)
    if phrases:
        found = found | text.rlike("(?i)" + "|".join(f"[{_GAP}]+".join(p.split()) for p in phrases))
    return found


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


_FOUND = "array<struct<template:int,at:int,label:string,base:boolean,share:double,score:double>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and found: (template, at, label, base, share, score) of every verified place, for docs (doc_id, text)."""
    index = index_of(templates)
    need = needed(templates, index)
    postings: dict[str, list[Anchor]] = {}
    for a in index:
        postings.setdefault(a.word, []).append(a)
    text = F.coalesce("text", F.lit(""))
    by_word = F.create_map(*(c for w, some in sorted(postings.items()) for c in (F.lit(w), F.array(*(F.struct(F.lit(a.template)
        .alias("t"), F.lit(a.number).alias("a"), F.lit(a.at).alias("at")) for a in some)))))
    size = Counter(a.template for a in index)
    facts = F.array(
        *(
            F.struct(
                F.lit(need[n]).alias("need"), F.lit(t.tolerance).alias("tolerance"), F.lit(size[n]).alias("indexed"), F.lit(t.label).alias(
                    "label"), F.lit(t.base).alias("base"), F.lit(t.specific).alias("specific"),
                F.array(*(F.struct(F.lit(at).alias("at"), F.lit(k).alias("n"), F.lit(f" {p} ").alias("phrase")) for at, k, p in t.keys)).alias(
                    "keys"),
            )
            for n, t in enumerate(templates)
        )
    )

    rows = docs.select("doc_id", F.regexp_count(text, F.lit(f"[^{_GAP}]++")).cast("long").alias("n_words"), F.when(may_hold(text, templates),
        F.regexp_extract_all(lowered(text), F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    rows = rows.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(*sorted(
        postings))))
    votes = F.flatten(F.transform("hits", lambda h: F.transform(by_word[h["w"]], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"])
        .alias("d"), p["a"].alias("a")))))
    rows = rows.withColumn("votes", F.array_sort(votes))

    def share(v: Column, i: Column) -> Column:
        """Indexed words with a vote from v's beginning to the tolerance behind it: they follow v, at most one for each word and shift."""
        fact = F.get(facts, v["t"])
        last = F.get("votes", i + fact["need"] - 1)
        near = F.slice("votes", i + 1, fact["indexed"] * (fact["tolerance"] + 1))
        agree = F.array_distinct(F.transform(F.filter(near, lambda x: (x["t"] == v["t"]) & (x["d"] <= v["d"] + fact["tolerance"])), lambda x: x["a"]))
        return F.when((last["t"] == v["t"]) & (last["d"] <= v["d"] + fact["tolerance"]), F.size(agree) / fact["indexed"])

    def holds(v: Column, key: Column, tolerance: Column) -> Column:
        """Whether a key phrase stands within the tolerance of its place."""
        start = F.greatest(F.lit(0), v["d"] + key["at"] - tolerance)
        end = F.greatest(start, v["d"] + key["at"] + key["n"] + tolerance)
        return F.contains(F.concat(F.lit(" "), F.array_join(F.slice("words", start + 1, end - start), " "), F.lit(" ")), key["phrase"])

    shared_ = F.transform("votes", lambda v, i: F.struct(v["t"].alias("t"), v["d"].alias("d"), share(v, i).alias("share")))
    agreed = F.filter(shared_, lambda v: F.coalesce(v["share"] * F.get(facts, v["t"])["indexed"] >= F.get(facts, v["t"])["need"] - 0.5, F.lit(False)))
    rows = rows.withColumn("agreed", agreed)
    verified = F.filter("agreed", lambda v: F.forall(F.get(facts, v["t"])["keys"], lambda k: holds(v, k, F.get(facts, v["t"])["tolerance"])))

    def told(v: Column) -> Column:
        fact = F.get(facts, v["t"])
        return F.struct(v["t"].alias("template"), v["d"].alias("at"), fact["label"].alias("label"), fact["base"].alias("base"), v["share"].alias(
            "share"), (v["share"] * fact["specific"]).alias("score"))

    return rows.select("doc_id", "n_words", F.coalesce(F.transform(verified, told).cast(_FOUND), F.array().cast(_FOUND)).alias("found"))


def summarised(found: DataFrame) -> DataFrame:
    """Digest columns of scan()'s rows."""
    base = F.filter("found", lambda f: f["base"])
    rows = found.withColumn("base", base)
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["label"]))), ",")
    places = F.transform("base", lambda f: f["at"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names("base").alias("base_labels"),
        names("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )
