"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, names and measuring units (by what they measure) turn into typed
slots, other words are lower-cased, operators between numbers stay, other punctuation goes.  Every text is read in three ways, as what a capitalised
word is can't be told (see ``templates``).  Windows of ``WINDOW`` template tokens are joined by hash
between documents and benchmark items, so a question that was copied with other numbers or names
still meets its item; windows that are mostly slots say too little without their values and are
hashed with them.  Windows that line up on one diagonal are one match; it counts if it covers
enough of the item and its slots are consistent, or at most ``WRONG`` percent of the item's tokens are
not matched with their own values.

Consistency is judged on the texts, over the item's whole extent in the document and not only in its matched
windows (``consistent``): one name of the item always stands for one name of the document, also where it
opens a sentence; units map one to one; a number that the item repeats may become different ones only where
most repeats agree or ``ENOUGH`` other words are the item's own (they may count different things), and not
where names are read as words, which is for copies.  New names and numbers may coincide.  Where an item is
found with its own values, others of its template aren't found at the same place with other ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlore.llm.common import RollingHash, mix, slices, written

WINDOW = 8
REFS_BYTES = 64 << 20         # of names of documents that may be broadcast
REF_BYTES = 64               # of one, at most
SHORTEST = 4                 # template tokens an item must have to be looked for by its template
EXACT = 3                    # tokens an item must have to be looked for at all, below SHORTEST with its values
ENOUGH = 13                  # tokens (or the whole item) that a match must cover
WRONG = 5                    # percent of an item's tokens that may be missing or have other values without being consistent
LITERAL = 2                  # the reading without names
FILTER_WINDOWS = 4_000_000   # benchmark windows up to which their hashes (32 MB) are sent to the tasks
MEMO_TOKENS = 240_000        # some 40 MB in a worker; speed only
READ_CHARS = 200_000         # speed only

# Words for numbers and units that become slots.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                         "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
                         "hundred thousand million billion dozen".split())
UNITS = {
    "length": "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres",
    "mass": "mg g kg gram grams kilogram kilograms pound pounds ounce ounces lb lbs oz ton tons",
    "volume": "ml l liter liters litre litres gallon gallons",
    "time": "second seconds minute minutes hour hours day days week weeks month months year years",
    "money": "dollar dollars euro euros cent cents",
    "share": "percent",
    "angle": "degree degrees",
    "speed": "mph kmh kph",
}

_TOKEN = re.compile(r"[.!?\n:;,\"“”„«»()\[\]]|[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*"
                    r"|[+*×÷^=](?= ?[\d(])|[-–−/](?<=[\d)] .)(?= [\d(])")
_END, _BREAK, _WORD, _OPERATOR, _NUMBER, _CAPITAL, _UNIT = range(7)       # slots from _NUMBER on, kinds of units from _UNIT on
_ENDS, _BREAKS = ".!?\n", ':;,"“”„«»()[]'
_MARKS = frozenset(_ENDS + _BREAKS)
_OPERATORS = frozenset("+*×÷^=-–−/")
_SLOTS = ("", "", "", "", "number", "name", *UNITS)
_UNIT_KIND = {word: _UNIT + k for k, some in enumerate(UNITS.values()) for word in some.split()}
_KIND = np.uint64(15)
_HEAVY = 1 << 32             # apart from any width: windows that are hashed with their values


class _Codes(dict):
    """Token -> the place in ``values`` of the hash of its lower-case form, with its kind in the low bits."""

    def __init__(self):
        super().__init__()
        self.values = array("Q")

    def of(self, tokens: list[str]) -> np.ndarray:
        places = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        codes = np.array(self.values, np.uint64)[places]
        while len(self) > MEMO_TOKENS:      # the newest go
            self.popitem()
        del self.values[MEMO_TOKENS:]
        return codes

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in _MARKS:
            kind = _END if token in _ENDS else _BREAK
        elif token[0].isdecimal() or low in NUMBER_WORDS:
            kind = _NUMBER
        elif low in _UNIT_KIND:
            kind = _UNIT_KIND[low]
        elif token in _OPERATORS:
            kind = _OPERATOR
        elif token[0].isupper() and not (len(token) > 1 and token.isupper()):
            kind = _CAPITAL
        else:
            kind = _WORD
        code = xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")) & ~15 | kind
        self[token] = place = len(self.values)
        self.values.append(code)
        return place


_CODES = _Codes()


class Template:
    """One reading of some texts as template tokens; ``owner`` is the number of each one's text."""

    def __init__(self, found: list[str], code: np.ndarray, kind: np.ndarray, join: np.ndarray, at: np.ndarray, owner: np.ndarray):
        """``join``: the token belongs to the name before it; ``at``: its place in ``found``."""
        first = np.flatnonzero((kind > _BREAK) & ~join)
        self._found, self.kind = found, kind[first]
        self.capital = (code[first] & _KIND) == _CAPITAL        # however it is read here
        self._first, self._last = at[first], at[np.append(first[1:], len(kind))[:len(first)] - 1]
        self.owner = owner[self._first]
        slot = self.kind >= _NUMBER
        self._read = code, kind, first
        self.codes = np.where(slot, mix(self.kind.astype(np.uint64)), mix(code[first] >> np.uint64(4)))
        words = self.kind == _WORD
        self.words, self.told = (np.concatenate(([0], np.cumsum(x))) for x in (words, words | slot))

    def __len__(self) -> int:
        return len(self.codes)

    def _values(self) -> np.ndarray:
        code, kind, first = self._read
        plain = np.where(kind <= _BREAK, np.uint64(0), code >> np.uint64(4))
        slot = self.kind >= _NUMBER
        return mix((np.add.reduceat(plain, first) if len(first) else plain[:0]) + self.kind.astype(np.uint64) * slot)

    def inside(self, width: int) -> np.ndarray:
        """Windows that lie in one text."""
        return self.owner[width - 1:] == self.owner[:max(0, len(self) - width + 1)]

    def light(self, width: int) -> np.ndarray:
        """Windows of which at least half is words (operators aside), so that the template alone says enough."""
        if len(self) < width:
            return np.empty(0, bool)
        words, told = (x[width:] - x[:-width] for x in (self.words, self.told))
        return (words > 0) & (2 * words >= told) & (width >= SHORTEST)

    def windows(self, width: int, heavy: bool = True) -> np.ndarray:
        """Hash of each window: of its template, or (if ``heavy`` ones are asked for) with the values of its slots
        where it is not ``light``."""
        if len(self) < width:
            return np.empty(0, np.uint64)
        h = RollingHash(self.codes).every(width) + np.uint64(width)
        if heavy and not (light := self.light(width)).all():
            h = np.where(light, h, RollingHash(self._values()).every(width) + np.uint64(width + _HEAVY))
        return h

    def slots(self, start: int, width: int) -> list[str]:
        """``kind:value`` of the slots of a window in order."""
        return [f"{_SLOTS[self.kind[k]]}:{self.value(k)}" for k in range(start, start + width) if self.kind[k] >= _NUMBER]

    def value(self, k: int) -> str:
        return " ".join(t for t in self._found[self._first[k]:self._last[k] + 1] if t not in _MARKS).lower()


def templates(texts: list[str | None], readings: Container[int] = range(3)) -> list[Template | None]:
    """The readings of texts (those asked for), which differ in what a capitalised word is.

    0: a name, but a word where it opens a sentence; 1: always a name, which any mark ends; 2: always
    a word.  What a token is in 2 doesn't depend on what precedes it or on its case, so a copy after a
    colon or in lower case is met there; in 1 other names are met that open sentences.
    """
    found, sizes = [], []
    for text in texts:
        some = _TOKEN.findall(text or "")
        some.append("\n")
        found += some
        sizes.append(len(some))
    owner = np.repeat(np.arange(len(texts)), sizes)
    code = _CODES.of(found)
    kind = (code & _KIND).astype(np.int8)
    at = np.arange(len(found))
    out: list[Template | None] = [None] * 3
    if 0 in readings:
        some = kind != _BREAK            # they don't end names here
        code0, kind0, at0 = code[some], kind[some], at[some]
        opens = np.append(True, kind0[:-1] == _END)[:len(kind0)]
        kind0[(kind0 == _CAPITAL) & opens] = _WORD
        out[0] = Template(found, code0, kind0, _joins(kind0), at0, owner)
    if 1 in readings:
        out[1] = Template(found, code, kind, _joins(kind), at, owner)
    if LITERAL in readings:
        literal = np.where(kind == _CAPITAL, _WORD, kind).astype(np.int8)
        out[LITERAL] = Template(found, code, literal, np.zeros(len(kind), bool), at, owner)
    return out


def _joins(kind: np.ndarray) -> np.ndarray:
    """Capitalised words after another one, which belong to its name."""
    name = kind == _CAPITAL
    return name & np.append(False, name[:-1])[:len(name)]


class Wanted:
    """The hashes that the benchmark has; a table by their first bits spares most searches."""

    def __init__(self, hashes: np.ndarray):
        self._hashes = hashes
        bits = max(20, len(hashes).bit_length() + 4)
        self._shift = np.uint64(64 - bits)
        self._some = np.zeros(1 << bits, bool)
        self._some[hashes >> self._shift] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        found = self._some[h >> self._shift]
        some = np.flatnonzero(found)
        at = np.minimum(np.searchsorted(self._hashes, h[some]), len(self._hashes) - 1)
        found[some] = self._hashes[at] == h[some]
        return found


def _window_rows(ids: list[tuple], template: Template, reading: int, widths: dict[int, bool], wanted: Wanted | None) -> Iterator[tuple]:
    """Rows of the (wanted) windows of texts with these ``ids``; ``widths``: whether heavy ones are asked for, too."""
    start = np.searchsorted(template.owner, np.arange(len(ids)))
    for width, heavy in widths.items():
        h = template.windows(width, heavy) + np.uint64(reading)
        hit, light = template.inside(width), template.light(width)
        if not heavy:
            hit = hit & light
        if wanted is not None and len(h):
            hit = hit & wanted.has(h)
        for k in np.flatnonzero(hit).tolist():
            text = template.owner[k]
            yield (*ids[text], reading, int(h[k].view(np.int64)), k - int(start[text]), width, template.slots(k, width), bool(light[k]))


def _item_rows(item: int | None, text: str | None) -> Iterator[tuple]:
    """Rows of an item's readings; one that reads like the last, literal one would find nothing more."""
    read = templates([text])
    for reading, t in enumerate(read):
        if len(t) < EXACT or (reading != LITERAL and np.array_equal(t.codes, read[LITERAL].codes)):
            continue
        width = min(WINDOW, len(t))
        light = int(t.light(width).sum())
        need = min(ENOUGH, len(t)) - width + 1
        for r in _window_rows([(item,)], t, reading, {width: True}, None):
            at = r[3]
            places = (at + np.flatnonzero(t.kind[at:at + width] >= _NUMBER)).tolist()
            yield (*r, len(t), need, min(need, light) if light else need, places)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """``item_id, reading, hash, at, width, values, light, tokens, need, need_light, places`` of every item of ``EXACT``
    tokens or more; ``need``: windows that a match must have, or ``need_light`` ones that are light;
    ``places``: of the slots in the item."""
    names = "item_id reading hash at width values light tokens need need_light places".split()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), *[pa.int32()] * 3, pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += _item_rows(item, text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=names)

    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "item_id long, reading int, hash long, at int, width int, values array<string>, light boolean, "
                             "tokens int, need int, need_light int, places array<int>"))


def _groups(texts: list[str | None]) -> Iterator[slice]:
    """Neighbouring texts of some ``READ_CHARS`` together, to be read at once."""
    start = chars = 0
    for k, text in enumerate(texts):
        chars += len(text or "")
        if chars >= READ_CHARS or k == len(texts) - 1:
            yield slice(start, k + 1)
            start, chars = k + 1, 0


def _ref() -> Column:
    """``common.row_ref`` whatever the type of ``doc_id``."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def document_windows(docs: DataFrame, widths: dict[int, dict[int, bool]], wanted: np.ndarray | None) -> DataFrame:
    """Windows of the documents, of these widths by reading (and whether heavy ones, too); only those whose hash is
    ``wanted``, if given."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = None if shared.value is None or not len(shared.value) else Wanted(shared.value)
        for batch in slices(batches):
            rows = []
            docs, refs, texts = (batch.column(c).to_pylist() for c in ("doc_id", "ref", "text"))
            for some in _groups(texts) if widths else ():
                ids, read = [*zip(docs[some], refs[some], strict=True)], templates(texts[some], widths)
                for reading in widths:
                    rows += [r[:-1] for r in _window_rows(ids, read[reading], reading, widths[reading], hashes)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "ref", "reading", "hash", "place", "width", "slots"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), _ref().alias("ref"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, ref long, reading int, hash long, place int, width int, slots array<string>"))


def consistent(item: list[Template], doc: Template, reading: int, diagonal: int) -> bool:
    """Whether the slots of an item (its readings) are consistent in a text that has it at this diagonal.

    Only places beside one that agrees are compared, so that words put into the text, which move what
    follows off the diagonal, say nothing.
    """
    it = item[reading]
    start, end = max(0, -diagonal), min(len(it), len(doc) - diagonal)
    if end <= start:
        return False
    here, there = slice(start, end), slice(start + diagonal, end + diagonal)
    agrees = it.codes[here] == doc.codes[there]
    beside = np.zeros(len(agrees), bool)
    beside[1:] |= agrees[:-1]
    beside[:-1] |= agrees[1:]
    slot = agrees & (it.kind[here] >= _NUMBER)
    names = {item[0].value(k) for k in np.flatnonzero(item[0].kind == _CAPITAL).tolist()}    # not those that only open sentences
    both = it.capital[here] & doc.capital[there]
    maps: dict[str, dict[str, list[str]]] = {"name": {}, "number": {}, "unit": {}}
    for k in np.flatnonzero(beside & (slot | both)).tolist():
        kind, value, other = int(it.kind[start + k]), it.value(start + k), doc.value(start + diagonal + k)
        if kind == _NUMBER:
            maps["number"].setdefault(value, []).append(other)
        elif kind >= _UNIT:
            maps["unit"].setdefault(value, []).append(other)
        elif slot[k] or value in names:
            maps["name"].setdefault(value, []).append(other)
    if any(len(set(v)) > 1 for kind in ("name", "unit") for v in maps[kind].values()):
        return False
    units = [v[0] for v in maps["unit"].values()]
    if len(set(units)) < len(units):
        return False
    split = [v for v in maps["number"].values() if len(set(v)) > 1]
    strict = reading == LITERAL and not np.array_equal(it.codes, item[0].codes)
    if strict or not split:
        return not split
    literal = int((agrees & (it.kind[here] == _WORD)).sum())
    return literal >= ENOUGH or all(2 * max(map(v.count, set(v))) > len(v) for v in split)


def _judged(docs: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """The ``runs`` (a written table) whose slots are consistent in the texts, which are read again for it."""
    texts = docs.select(_ref().alias("ref"), F.col("text").cast("string").alias("text"))
    refs = runs.select("ref").distinct()
    if refs.count() * REF_BYTES <= REFS_BYTES:
        refs = F.broadcast(refs)
    texts = texts.join(refs, "ref", "left_semi").groupBy("ref").agg(F.first("text").alias("text"))
    wanted = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item"), F.col("text").cast("string").alias("item_text"))
    wanted = wanted.where(F.col("item_text").isNotNull()).groupBy("item").agg(F.collect_set("item_text").alias("item_texts"))
    # once per place of a document; a text goes with its runs, so a document's runs are one row
    asked = (runs.select("ref", "item", "reading", "diagonal").distinct().join(wanted, "item")
             .groupBy("ref").agg(F.collect_list(F.struct("item", "reading", "diagonal", "item_texts")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            out, known = [], {}
            for ref, text, some in zip(*(batch.column(c).to_pylist() for c in ("ref", "text", "runs")), strict=True):
                doc = templates([text])
                for r in some:
                    for item_text in r["item_texts"]:
                        if item_text not in known:
                            known[item_text] = templates([item_text])
                        if consistent(known[item_text], doc[r["reading"]], r["reading"], r["diagonal"]):
                            out.append((ref, r["item"], r["reading"], r["diagonal"]))
                            break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["ref", "item", "reading", "diagonal"])

    good = texts.join(asked, "ref").select("ref", "text", "runs").mapInArrow(run, "ref long, item long, reading int, diagonal int")
    return runs.join(good, ["ref", "item", "reading", "diagonal"], "left_semi")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, ref, item_id, tokens_matched, item_tokens, n_slots, same_slots``: one row per document
    row and item of the benchmark found in it (equal rows share one).

    ``same_slots``: all slot values are the item's own (a copy); otherwise the question was given others.
    Null or empty texts match nothing; nor do items of under ``EXACT`` tokens.  An item of under
    ``SHORTEST`` matches with its own values only.  The longest of an item's matches in a document is
    returned, the first of equals; its tokens are those of the reading in which it was found.  A null ``doc_id`` stays null;
    a null ``item_id`` is an item like others.  Without documents or items there are no rows.
    """
    bench = written(benchmark_windows(items), "benchmark-windows")
    widths: dict[int, dict[int, bool]] = {}      # the documents are read in the ways that some item has; at most 3 * WINDOW values
    for r in bench.groupBy("reading", "width").agg(F.bool_or(~F.col("light")).alias("heavy")).orderBy("reading", "width").collect():
        widths.setdefault(r.reading, {})[r.width] = r.heavy
    wanted = None
    if bench.count() <= FILTER_WINDOWS:       # else the join alone sorts the windows out
        wanted = np.unique(np.array([r.hash for r in bench.select("hash").distinct().toLocalIterator()], np.int64).view(np.uint64))
    bench = bench.select(F.coalesce("item_id", F.lit(-1)).alias("item"), "item_id", F.col("reading").alias("as"),
                         F.col("hash").alias("key"), "at", "places", "values", "light", "tokens", "need", "need_light")
    hits = document_windows(docs, widths, wanted).join(bench, (F.col("hash") == F.col("key")) & (F.col("reading") == F.col("as")))
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    line = ["doc_id", "ref", "item", "item_id", "reading", "diagonal"]
    runs = hits.groupBy(*line).agg((F.max("at") - F.min("at") + F.max("width")).alias("tokens_matched"),
                                   F.count_distinct("at").alias("windows"),
                                   F.count_distinct(F.when(F.col("light"), F.col("at"))).alias("light_windows"),
                                   F.max("need").alias("need"), F.max("need_light").alias("need_light"),
                                   F.max("tokens").alias("item_tokens"),
                                   F.max("width").alias("width"),
                                   F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("places", "values", "slots")))).alias("places"))
    runs = runs.withColumn("pairs", F.array_distinct(F.transform("places", lambda p: F.struct(p["values"].alias("values"), p["slots"].alias("slots")))))
    pairs = F.col("pairs")
    wrong = F.size(F.array_distinct(F.transform(F.filter("places", lambda p: p["values"] != p["slots"]), lambda p: p["places"])))
    covered = F.col("windows") + F.col("width") - 1         # tokens at least
    near = 100 * (F.col("item_tokens") - covered + wrong) <= WRONG * F.col("item_tokens")
    enough = (F.col("windows") >= F.col("need")) | (F.col("light_windows") >= F.col("need_light"))
    runs = written(runs.where(enough).select(*line, "tokens_matched", "item_tokens", F.size(pairs).alias("n_slots"), near.alias("near"),
                                             F.forall(pairs, lambda p: p["values"] == p["slots"]).alias("same_slots")), "benchmark-runs")
    good = runs.where("near").unionByName(_judged(docs, items, runs.where(~F.col("near"))))
    # the items of one template at one place of a document: the ones found as they are, if any
    place = Window.partitionBy("ref", "reading", "diagonal", "item_tokens")
    good = (good.withColumn("copied", F.max(F.when(F.col("same_slots"), F.col("tokens_matched"))).over(place))
            .where(F.col("same_slots") | F.col("copied").isNull() | (F.col("copied") < F.col("tokens_matched"))))
    best = F.max_by(F.struct("tokens_matched", "item_tokens", "n_slots", "same_slots"),
                    F.struct("tokens_matched", -F.col("reading"), -F.col("diagonal"))).alias("best")
    return good.groupBy("doc_id", "ref", "item", "item_id").agg(best).select("doc_id", "ref", "item_id", "best.*")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a match (columns as they were)."""
    taken = {c.lower() for c in docs.columns}
    name = "ref"
    while name in taken:
        name += "_"
    found = matches(docs, items).select(F.col("ref").alias(name)).distinct()
    return docs.join(found, _ref() == F.col(name), "left_anti")
