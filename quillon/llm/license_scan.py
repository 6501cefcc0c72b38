"""License scans by matching statistics over a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every notice, and each state all places where its runs end. A text's words
stream through it; after each word the state's length is the longest run ending there that some notice contains (its
matching statistic), and the first state above it that a notice shares gives that notice's own statistic, so what two
notices have in common counts for both. A notice's maximal runs of at least MIN_RUN words are anchors, one for each place
where it has them. Of one notice, anchors that follow each other in text and notice, at most MAX_GAP words apart in
either, are chained so that most words are covered. A chain counts where its matched words cover COVERED of the notice,
unless one of another notice that overlaps it covers more words (or as many and a larger share): the spans left give the
notices' labels. Only stretches of words that the notices use are walked: a statistic cannot reach MIN_RUN in fewer
words. Phrases are counted apart, exactly, wherever their words stand one after another; the method's labels are added to
theirs and never take any away.

The score takes the best span's share as one piece of evidence and each place of a phrase as a weak one:
1 - (1 - share) * (1 - PLACE) ** places.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z: a-z, 0-9 and all beyond ASCII.

Notices and phrases are parameters; a notice has MIN_RUN words at least. Defined results: a null or empty text has no
words, no places and score 0; equal rows give equal results; an empty table gives an empty result; other columns play no
part, whatever they are called. A text is scanned whole, in time linear in its length.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES, PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIN_RUN, MAX_GAP, COVERED, PLACE = 6, 12, 0.5, 0.2
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class SuffixAutomaton:
    """Of several word sequences. ends[state] has by sequence the places after the last word of its runs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for s, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].setdefault(s, set()).add(at + 1)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            for s, places in self.ends[state].items():
                self.ends[self.link[state]].setdefault(s, set()).update(places)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow), self.length.append(length), self.link.append(link), self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A state for the runs of q that are one longer than p's; p and its suffixes lead there."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # an earlier sequence has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new

    def walk(self, symbols: list[int]) -> list[tuple[int, int]]:
        """After each symbol (state, matching statistic)."""
        state, length, found = 0, 0, []
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            found.append((state, length))
        return found

    def runs(self, walked: list[tuple[int, int]], sequence: int) -> Iterator[tuple[int, int, set[int]]]:
        """Maximal matches with one sequence: (place after the last symbol, length, places in the sequence after the last symbol)."""
        before = (0, 0, set())
        for at, (state, length) in enumerate(walked):
            while state and sequence not in self.ends[state]:
                state = self.link[state]
                length = self.length[state]
            if before[1] and length != before[1] + 1:
                yield before
            before = (at + 1, length, self.ends[state].get(sequence, set()) if length else set())
        if before[1]:
            yield before


class Span(NamedTuple):
    notice: str
    start: int
    end: int
    covered: float


def chains(anchors: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Anchors (start in the text, length, start in the notice) as disjoint chains, that which covers most words first.

    An anchor that begins inside the one before it is taken from that one's end.
    """
    anchors = sorted(set(anchors))
    best, link = [a[1] for a in anchors], [-1] * len(anchors)
    open_: list[int] = []
    for i, (start, length, place) in enumerate(anchors):
        open_ = [j for j in open_ if anchors[j][0] + anchors[j][1] + MAX_GAP >= start]
        for j in open_:
            end, upto = anchors[j][0] + anchors[j][1], anchors[j][2] + anchors[j][1]
            cut = max(0, end - start)
            if cut < length and anchors[j][0] < start and 0 <= place + cut - upto <= MAX_GAP and best[j] + length - cut > best[i]:
                best[i], link[i] = best[j] + length - cut, j
        open_.append(i)
    used = [False] * len(anchors)
    for i in sorted(range(len(anchors)), key=lambda k: (-best[k], k)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(anchors[i])
            i = link[i]
        if chain:
            yield chain[::-1]


class Scanner:
    def __init__(self, notices: dict[str, str], phrases: dict[str, str]):
        self.names = list(notices)
        split = [words_of(notices[n]) for n in self.names]
        self.sizes = [len(x) for x in split]
        if min(self.sizes, default=MIN_RUN) < MIN_RUN:
            raise ValueError(f"a notice has {MIN_RUN} words at least; give shorter ones as phrases")
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for x in split for w in x))}
        self.automaton = SuffixAutomaton([[self.ids[w] for w in x] for x in split])
        self.least = MIN_RUN
        self.phrases = [(p.split(" "), label) for p, label in phrases.items()]

    def phrase_places(self, words: list[str]) -> list[tuple[int, str]]:
        """(start, label) of every place of every phrase."""
        places = []
        for phrase, label in self.phrases:
            first, at = min(phrase, key=lambda w: words.count(w)), -1
            shift = phrase.index(first)
            while True:
                try:
                    at = words.index(first, at + 1)
                except ValueError:
                    break
                start = at - shift
                if start >= 0 and words[start : start + len(phrase)] == phrase:
                    places.append((start, label))
        return sorted(places)

    def stretches(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(start, symbols) of each stretch of at least `least` words that notices use."""
        get, run, start = self.ids.get, [], 0
        known = list(map(get, words))
        at, n = 0, len(known)
        while at < n:
            if known[at] is None:
                at += 1
                continue
            start = at
            while at < n and known[at] is not None:
                at += 1
            if at - start >= self.least:
                run = known[start:at]
                yield start, run

    def anchors(self, words: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """By notice its anchors: (start in the text, length, start in the notice)."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        automaton = self.automaton
        for start, symbols in self.stretches(words):
            walked = automaton.walk(symbols)
            if max(length for _, length in walked) < MIN_RUN:
                continue
            notices: set[int] = set()
            for state, length in walked:
                while length >= MIN_RUN:
                    notices |= automaton.ends[state].keys()
                    state = automaton.link[state]
                    length = automaton.length[state]
            for notice in notices:
                for end, length, places in automaton.runs(walked, notice):
                    if length >= MIN_RUN:
                        found.setdefault(notice, []).extend((start + end - length, length, place - length) for place in places)
        return found

    def spans(self, words: list[str]) -> list[Span]:
        """The spans of words that notices cover, in order."""
        found = []
        for notice, own in self.anchors(words).items():
            for chain in chains(own):
                covered, end = 0, 0
                for start, length, _ in chain:
                    covered += start + length - max(start, end)
                    end = start + length
                if covered >= COVERED * self.sizes[notice]:
                    found.append((covered, Span(self.names[notice], chain[0][0], end, min(1.0, covered / self.sizes[notice]))))
        found.sort(key=lambda x: (-x[0], -x[1].covered, x[1].start, x[1].notice))
        kept: list[Span] = []
        for _, span in found:
            if all(span.end <= k.start or span.start >= k.end for k in kept):
                kept.append(span)
        return sorted(kept, key=lambda s: (s.start, s.end, s.notice))


@lru_cache(2)
def _scanner(notices: tuple, phrases: tuple) -> Scanner:
    return Scanner(dict(notices), dict(phrases))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per input row: id_col, n_words, places array<struct<start, label>> of phrases, spans array<struct<notice, start, end, covered>>."""
    sides = tuple(notices.items()), tuple(phrases.items())

    def run(batches):
        s = _scanner(*sides)
        for batch in batches:
            n, places, spans = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text or "")
                n.append(len(words))
                places.append([{"start": at, "label": label} for at, label in s.phrase_places(words)])
                spans.append([x._asdict() for x in s.spans(words)])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, kinds[0]), pa.array(spans, kinds[1])], ["id", "n_words", "places", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, places array<struct<start: long, label: string>>, spans array<struct<notice: string, start: long, end: long, covered: double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: Bytes of whole notices that a table may hold: the automaton of that many stands in every worker.
NOTICE_BYTES = 4 << 20


def notices_of(table: DataFrame, label_col: str, text_col: str, most_bytes: int = NOTICE_BYTES) -> dict[str, str]:
    """Notices for `scan` from a table of whole licence texts, one row per label. A table beyond most_bytes fails, and so does a label with two texts; null labels and texts of fewer than MIN_RUN words stay out."""
    own = table.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).dropna()
    n_bytes = own.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("label")), F.lit(0))).first()[0]
    if n_bytes > most_bytes:
        raise ValueError(f"{n_bytes} bytes of notices; at most {most_bytes}")
    rows = sorted((r["label"], r["text"]) for r in own.collect())
    if len({label for label, _ in rows}) < len(rows):
        raise ValueError("a label has several texts")
    return {label: text for label, text in rows if len(words_of(text)) >= MIN_RUN}


def digest(found: DataFrame) -> DataFrame:
    """scan's rows as counts, places and labels."""
    starts, spans = F.col("places.start"), F.col("spans")
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    best = F.coalesce(F.array_max(F.transform(spans, lambda s: s["covered"])), F.lit(0.0))
    return found.withColumns(
        {
            "n_base": F.size("places").cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": F.array_join(base, ","),
            "labels": F.array_join(F.array_sort(F.array_union(base, F.col("spans.notice"))), ","),
            "score": 1 - (1 - best) * F.pow(F.lit(1 - PLACE), F.size("places")),
        }
    )
