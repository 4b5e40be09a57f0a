"""Benchmark decontamination by canonical templates.

Words of documents and items become typed placeholders where they can be swapped without changing the
question: numbers, units, and names (capitalised inside a sentence). Windows of K words are hashed twice,
as written and as templates, and joined to the windows of the items. An item is found where enough of
its windows are; if only its templates are, the slots must also be consistent within one occurrence: each
value of the item stands for one value in the document, as in a re-parameterised copy. Occurrences are told
apart by the offset of a hit in the document against its place in the item; a document may hold many.

A bitmap of fixed size spares windows that are in no item from the join, so nothing that grows with the
benchmark is broadcast, and the joins are ordinary ones. The first finds candidates: an item's windows that the
fewest items share, so many that one of them must be met. Only for these pairs are all windows joined, so an
opening that hundreds of items and documents share makes no pairs by itself."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import in_bitmap, key_bitmap, materialise, per_document, rolling

K, SHARE, LITERALS, SLACK = 6, 0.4, 3, 4
#: Items of fewer words are found only where they are a whole document.
TELLING = 3
KEPT = 400_000
BARE = re.compile(r"^\W+|\W+$")
NUMBER = re.compile(r"[+-]?[\d.,:/]*\d[\d.,:/]*(?:st|nd|rd|th)?")
#: Number words.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
#: Measures and currencies, any of which can stand in a slot.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur "
    "mph kmh percent degree degrees celsius fahrenheit watt watts volt volts joule joules".split()
)
PLAIN, NUM, UNIT, END = 0, 1, 2, 4


class Memo(dict):
    """White-space chunk -> its number, under which lie the hash of its bare lower-case word, its class, and whether
    it is capitalised, ends a sentence, and has a word. Bounded, as it starts anew when full."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.hash, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        self.cap = self.end = self.word = np.zeros(0, bool)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n

    def look(self, chunks: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self) > KEPT:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.fresh:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for c in self.fresh:
                plain = c.isalpha()
                bare = c if plain else BARE.sub("", c)
                word = bare.lower()
                kind = NUM if word in NUMBER_WORDS or not plain and NUMBER.fullmatch(word) else UNIT if word in UNITS else PLAIN
                for col, v in zip(cols, (xxh64_intdigest(word.encode(errors="surrogatepass")), kind, len(bare) > 1 and bare[0].isupper(), c[-1] in ".!?:;", bool(bare)), strict=True):
                    col.append(v)
            new = [np.array(x, t) for x, t in zip(cols, (np.uint64, np.int8, bool, bool, bool), strict=True)]
            self.hash, self.kind, self.cap, self.end, self.word = (np.concatenate(x) for x in zip((self.hash, self.kind, self.cap, self.end, self.word), new, strict=True))
            self.fresh = []
        return at


class Canon:
    """The words of several texts in a row: hash as written, hash as template, whether it is a slot, its text and its place there.

    Chunks without a word are left out, but end the sentence of the word before."""

    def __init__(self, texts: list[str | None], memo: Memo):
        chunks: list[str] = []
        sizes = []
        for t in texts:
            part = (t or "").split()
            sizes.append(len(part))
            chunks += part
        at = memo.look(chunks)
        owner = np.repeat(np.arange(len(texts)), sizes)
        end, word = memo.end[at], memo.word[at]
        if not word.all():
            before = np.cumsum(word)[end] - 1
            same = before >= 0
            own = owner[end]
            at, owner = at[word], owner[word]
            same[same] = owner[before[same]] == own[same]
            end = np.zeros(len(at), bool)
            end[before[same]] = True
        self.plain, kind = memo.hash[at], memo.kind[at]
        self.owner = owner
        self.size = np.bincount(owner, minlength=len(texts))
        self.place = np.arange(len(at)) - (np.cumsum(self.size) - self.size)[owner]
        inside = np.zeros(len(at), bool)
        inside[1:] = ~end[:-1]
        inside[self.place == 0] = False
        self.slot = (kind != PLAIN) | (memo.cap[at] & inside)
        self.template = np.where(kind == NUM, np.uint64(1), np.where(kind == UNIT, np.uint64(2), np.where(self.slot, np.uint64(3), self.plain)))

    def written(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each window of k words within a text."""
        h = rolling(self.plain, k)
        at = np.flatnonzero(self.owner[: len(h)] == self.owner[len(self.owner) - len(h) :])
        return h[at], at

    def shaped(self, k: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of windows as templates, of those with a slot and enough words as written."""
        h = rolling(self.template, k) ^ np.uint64(0x5555555555555555)
        upto = np.concatenate([[0], np.cumsum(self.slot)])
        slots = upto[k : k + len(h)] - upto[: len(h)]
        at = np.flatnonzero((self.owner[: len(h)] == self.owner[len(self.owner) - len(h) :]) & (slots > 0) & (k - slots >= literals))
        return h[at], at

    def values(self, at: np.ndarray, k: int) -> list[list[int]]:
        """The words in the slots of windows, zero for others."""
        vals = np.where(self.slot, self.plain, np.uint64(0)).view(np.int64)
        return vals[at[:, None] + np.arange(k)].tolist()


def windows_of(ids: list, texts: list[str | None], memo: Memo, k: int, literals: int, short: list[int] | None = None, keep=None) -> dict:
    """The windows of texts, one row each: all of them, or those whose hash `keep` holds for.

    A text of fewer than k words is one window (short: None); or, to be looked up in longer ones, each
    text also has its windows of the lengths in `short`, those under TELLING only as a whole text."""
    canon = Canon(texts, memo)
    parts = []
    for n in [*(short if short is not None else range(1, k)), k]:
        w, at = canon.written(n)
        if n < k and (short is None or n < TELLING):
            whole = canon.size[canon.owner[at]] == n
            w, at = w[whole], at[whole]
        parts.append((n, False, w, at))
    parts.append((k, True, *canon.shaped(k, literals)))
    out: dict[str, list] = {c: [] for c in ("id", "p", "n", "shaped", "w", "vals", "total")}
    for n, shaped, w, at in parts:
        if keep is not None:
            hit = keep(w)
            w, at = w[hit], at[hit]
        owner = canon.owner[at]
        out["id"] += [ids[i] for i in owner.tolist()]
        out["p"] += canon.place[at].tolist()
        out["n"] += [n] * len(at)
        out["shaped"] += [shaped] * len(at)
        out["w"] += w.view(np.int64).tolist()
        out["vals"] += canon.values(at, k) if shaped else [[]] * len(at)
        out["total"] += np.maximum(canon.size[owner] - k + 1, 1).tolist()
    return out


def item_windows(items: DataFrame, k: int, literals: int) -> DataFrame:
    """items(item_id, text) -> item_id, pos, n, total, shaped, w, wants of each different text; the smallest item_id stands for equal ones."""
    memo = Memo()

    def run(ids, texts):
        got = windows_of(ids, texts, memo, k, literals)
        return {"item_id": got.pop("id"), "pos": got.pop("p"), "wants": got.pop("vals")} | got

    once = items.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    return per_document(once, ["item_id", "text"], run, "item_id long, pos int, n int, total int, shaped boolean, w long, wants array<long>")


def telling(windows: DataFrame, share: float) -> DataFrame:
    """The (w, shaped, item_id) by which a document can become a candidate for an item: windows at the places of the item that
    the fewest items share.

    Of n places at least `least` must be met, so one of any n - least + 1 of them is, and the rarest do."""
    least = F.least(F.col("total"), F.greatest(F.lit(2), F.ceil(share * F.col("total") - 1e-9)))
    held = windows.groupBy("w", "shaped").agg(F.count_distinct("item_id").alias("items"))
    places = windows.join(held, ["w", "shaped"]).groupBy("item_id", "pos", "total").agg(F.max("items").alias("items"))
    order = Window.partitionBy("item_id").orderBy("items", "pos")  # the places of one item
    rare = places.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.col("total") - least + 1)
    return windows.join(rare.select("item_id", "pos"), ["item_id", "pos"]).select("w", "shaped", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, k: int = K, share: float = SHARE, literals: int = LITERALS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> a row for each document and item found in it:
    doc_id, item_id, share (of the item's windows), kind (verbatim or reparameterised), first_word, last_word.

    An item is found if at least `share` of its windows, and two, are in the document: as
    written, or in one occurrence as templates with consistent slots; first_word and last_word
    span what was found. An item of fewer than k words is found where all of it stands as written; one of
    one or two words only where it is the whole document. Null or empty texts are not found. Items of equal
    text are found once, under the smallest item_id. Rows without a doc_id are left out; rows that
    repeat one count as one document. Other columns are ignored; an empty table on either side gives
    an empty result."""
    spark = docs.sparkSession
    windows = materialise(item_windows(items, k, literals))
    bitmap = spark.sparkContext.broadcast(key_bitmap(windows, "w"))
    short = sorted(r["n"] for r in windows.filter(F.col("n") < k).select("n").distinct().collect())  # fewer than k
    memo = Memo()

    def run(ids, texts):
        got = windows_of(ids, texts, memo, k, literals, short, lambda w: in_bitmap(bitmap.value, w))
        return {"doc_id": got.pop("id")} | got

    hits = materialise(per_document(docs.filter("doc_id is not null"), ["doc_id", "text"], run, "doc_id long, p int, n int, shaped boolean, w long, vals array<long>"))
    # candidates by telling windows, then all windows of the candidates' items: what many items share makes no pairs by itself
    pairs = materialise(hits.select("doc_id", "w", "shaped").distinct().join(telling(windows, share), ["w", "shaped"]).select("doc_id", "item_id").distinct())
    wanted = pairs.join(windows.drop("n"), "item_id")
    met = materialise(hits.join(wanted, ["doc_id", "w", "shaped"]).withColumn("lane", F.col("p") - F.col("pos")))
    # occurrences: the whole document, runs of lanes no further apart than the item is long or than a few words, and each lane alone
    order = Window.partitionBy("doc_id", "item_id").orderBy("lane")
    gap = F.col("lane") - F.lag("lane").over(order)
    lanes = met.select("doc_id", "item_id", "total", "lane").distinct().withColumn("far", F.coalesce(gap > F.col("total"), F.lit(False)).cast("int")).withColumn("apart", F.coalesce(gap > SLACK, F.lit(False)).cast("int"))
    runs = F.array(*[F.struct(F.lit(n).alias("level"), c.cast("long").alias("run")) for n, c in enumerate((F.lit(0), F.sum("far").over(order), F.sum("apart").over(order), F.col("lane")))])
    lanes = lanes.select("doc_id", "item_id", "lane", runs.alias("runs"))
    met = met.join(lanes, ["doc_id", "item_id", "lane"]).select("*", F.inline("runs"))
    place = ["doc_id", "item_id", "level", "run"]
    counted = met.groupBy(*place, "total").agg(F.count_distinct(F.when(~F.col("shaped"), F.col("pos"))).alias("plain"), F.count_distinct("pos").alias("any"), F.min("p").alias("first_word"), F.max(F.col("p") + F.col("n") - 1).alias("last_word"))
    pairs = met.filter("shaped").select(*place, F.explode(F.arrays_zip("wants", "vals")).alias("s")).filter("s.wants <> 0")
    slots = pairs.groupBy(*place).agg(F.count_distinct("s").alias("both"), F.count_distinct("s.wants").alias("wants"))
    joined = counted.join(slots, place, "left")
    enough = lambda c: (F.col(c) >= 2) & (F.col(c) >= share * F.col("total")) | (F.col(c) == F.col("total"))
    verbatim = (F.col("level") == 0) & enough("plain")
    rows = joined.withColumn("verbatim", verbatim).filter(F.col("verbatim") | enough("any") & F.coalesce(F.col("both") == F.col("wants"), F.lit(True)))
    best = F.max(F.struct("verbatim", (F.when(F.col("verbatim"), F.col("plain")).otherwise(F.col("any")) / F.col("total")).alias("share")))
    found = rows.groupBy("doc_id", "item_id").agg(best.alias("best"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    return found.select("doc_id", "item_id", "best.share", F.when(F.col("best.verbatim"), "verbatim").otherwise("reparameterised").alias("kind"), "first_word", "last_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = K, share: float = SHARE) -> DataFrame:
    """The documents in which no item is found, with all their columns; those without a doc_id stay.

    The ids of the others are written first, so that their size is known when the join with the texts is planned."""
    found = materialise(contaminated(docs, items, k, share).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
