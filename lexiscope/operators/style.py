"""Stylometric measures over documents, paragraphs, sentences and tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.session import prepare

CV_LOW, CV_HIGH, MATTR_LOW, MATTR_HIGH = 0.30, 0.50, 0.55, 0.70


UNIT = ("doc_id", "lang", "source")


def cut(base: DataFrame, keep: list[str], sentences: Column) -> DataFrame:
    """keep, sentences, counts (tokens of each), tokens."""
    x = base.select(*keep, sentences.alias("sentences"))
    x = x.select("*", F.transform("sentences", lambda s: T.tokenize(s, F.col("lang"))).alias("st"))
    return x.select(*keep, "sentences", F.transform("st", F.size).alias("counts"), F.flatten("st").alias("tokens"))


def units(docs: DataFrame, unit: str = "paragraph", keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """doc_id, lang, source, columns to keep, para_idx (from 1), text, sentences, counts (tokens of each sentence), tokens.

    With `outer` a text without paragraphs has one row, whose para_idx is null."""
    explode = F.posexplode_outer if outer else F.posexplode
    base = docs.select(*UNIT, *keep, explode(T.split_paragraphs("text", unit)).alias("i", "text"))
    base = base.select(*UNIT, *keep, (F.col("i") + 1).alias("para_idx"), "text")
    return cut(base, [*UNIT, *keep, "para_idx", "text"], T.prose_sentences(F.coalesce("text", F.lit("")) if outer else "text"))


def document_sentences(c: str | Column) -> Column:
    """Sentences of all paragraphs in order."""
    return F.flatten(F.transform(T.split_paragraphs(c), T.prose_sentences))


def plain_words(text: str | Column, lang: Column) -> Column:
    """A text whose words, cut by T.WORD, are the tokens of its sentences: a sentence ends at white space or a full-width stop, which alone can part a word."""
    sentences = document_sentences(text)
    cjk = F.array_join(F.flatten(F.transform(sentences, lambda s: T.tokenize(s, lang))), " ")
    return F.when(lang.isin(*T.CJK), cjk).when(T.full_stops(T.col(text)), F.array_join(sentences, "\n")).otherwise(T.strip_lists(text))


#: T.WORD for Python, whose \s and \w are wider than Java's.
BLANK = re.escape(T.BLANKS)
PYTHON_WORD = rf"[^\W_]++(?:(?:[^\w{BLANK}]|_)++[^\W_]++)*+"
#: Entries that a task counts before it hands them on.
COUNTED = 200_000


def document_frequency(docs: DataFrame) -> DataFrame:
    """lang, entry, n: how many documents of a language have a lower-case token, at least one.

    A task counts the words of its batches before they are shuffled."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, seen = re.compile(PYTHON_WORD), {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, held in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "entry", "n"])
            seen.clear()

        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen.setdefault(lang, Counter()).update({w.lower() for w in word.findall(text)})
                if sum(map(len, seen.values())) >= COUNTED:
                    yield from handed()
        yield from handed()

    words = docs.select("lang", plain_words("text", F.col("lang")).alias("text"))
    return words.mapInArrow(count, "lang string, entry string, n long").groupBy("lang", "entry").agg(F.sum("n").alias("n"))


def document_units(docs: DataFrame) -> DataFrame:
    """A document as one unit: sentences of all its paragraphs in order."""
    return cut(docs, [*UNIT, "text"], document_sentences("text"))


def total(c: str | Column) -> Column:
    return F.aggregate(T.col(c), F.lit(0).cast("long"), lambda a, x: a + x)


def squares(c: str | Column) -> Column:
    return F.aggregate(T.col(c), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)


def cv(c: str | Column) -> Column:
    """Population coefficient of variation of an array of counts; null under two values or for a mean of zero."""
    n = F.size(T.col(c))
    return F.when((n >= 2) & (total(c) > 0), F.sqrt((n * squares(c) - total(c) * total(c)).cast("double")) / total(c))


def band(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "low").when(value > high, "high").when(value.isNotNull(), "mid")


def burstiness(u: DataFrame) -> DataFrame:
    out = u.withColumn("n_sentences", F.size("counts")).withColumn("cv", T.round_half_up(cv("counts")))
    return out.withColumn("cv_band", F.when(F.col("n_sentences") >= 3, band(F.col("cv"), CV_LOW, CV_HIGH)))


def ranked(tokens: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a batch of token lists, whose types are lower-case: for each token in order of (row, type, place) its row, its place in it and its type's place before (-1 for none); and the length of each list."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
    coded = pc.dictionary_encode(pc.list_flatten(tokens), null_encoding="encode")
    types: dict[str | None, int] = {}
    lower = [types.setdefault(t and t.lower(), len(types)) for t in coded.dictionary.to_pylist()]
    codes = np.asarray(lower, np.int64)[np.asarray(coded.indices, np.int64)]
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = row * (codes.max(initial=0) + 1) + codes
    order = np.argsort(key, kind="stable")
    key, row, place = key[order], row[order], place[order]
    before = np.full(len(key), -1)
    again = key[1:] == key[:-1]
    before[1:][again] = place[:-1][again]
    return row, place, before, lengths


def moving_types(tokens: str | Column, window: int) -> Column:
    """The mean share of types over all windows of lower-case tokens, over all of them if they are fewer; null for none.

    A token adds its type to the windows that hold it and not the place before where the type was; the
    places before come from one sort of a batch's tokens by row and type."""

    @F.arrow_udf("double")
    def mean(tokens: pa.Array) -> pa.Array:
        row, i, before, n = ranked(tokens)
        adds = np.maximum(0, np.minimum(i, n[row] - window) - np.maximum(i - window, before))
        total, types = np.zeros(len(n), np.int64), np.bincount(row[before < 0], minlength=len(n))
        np.add.at(total, row, adds)
        share = np.where(n >= window, total / np.maximum(window * (n - window + 1), 1), types / np.maximum(n, 1))
        return pa.array(share, mask=n == 0)

    return mean(T.col(tokens))


def hapax(tokens: str | Column) -> Column:
    """How many types an array has once."""
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("run"), F.lit(0).alias("once"))

    def step(a: Column, x: Column) -> Column:
        same = F.coalesce(x == a["t"], F.lit(False))
        return F.struct(x.alias("t"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), (a["once"] + (~same & (a["run"] == 1)).cast("int")).alias("once"))

    return F.aggregate(F.sort_array(T.col(tokens)), start, step, lambda a: a["once"] + (a["run"] == 1).cast("int"))


def mattr(u: DataFrame, keys: list[str], window: int = 50) -> DataFrame:
    """keys, n_tokens, mattr of units with tokens; each row for itself.

    Units without tokens go by an empty list, as a filter would be pushed below the tokens and cut them twice."""
    x = u.select(*keys, F.size("tokens").alias("n_tokens"), T.round_half_up(moving_types("tokens", window)).alias("mattr"))
    return x.select(*keys, F.inline(F.filter(F.array(F.struct("n_tokens", "mattr")), lambda r: r["n_tokens"] > 0)))


def comma_density(d: DataFrame) -> DataFrame:
    commas = F.regexp_count("text", F.lit("[,，]"))
    chars = F.char_length(F.regexp_replace("text", rf"{T.WS}+", ""))
    return d.withColumns({"per_sentence": T.round_half_up(F.try_divide(commas, F.size("sentences"))), "per_100_chars": T.round_half_up(F.try_divide(commas * 100, chars))})


#: Connectives whose share is one of the twelve features.
CONNECTIVES = ("또한", "게다가", "뿐만", "따라서", "그러나", "하지만", "결론적으로", "즉", "특히", "한편", "그리고", "그래서", "때문에", "통해", "위해", "대한", "다양한", "효과적으로", "중요하다고", "있습니다", "바랍니다")
FEATURES = ("burstiness_cv", "mean_sent_len", "std_sent_len", "ttr", "mattr", "hapax_ratio", "mean_tok_len", "comma_per_sent", "punct_ratio", "ending_diversity", "connective_ratio", "digit_ratio")


def structural_features(docs: DataFrame, window: int = 40) -> DataFrame:
    """doc_id and the twelve structural features, 0 where one can't be worked out; null text is empty."""
    d = document_units(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    compact = F.regexp_replace("text", rf"{T.WS}+", "")
    lens = F.filter("counts", lambda x: x > 0)
    ends = T.non_empty(F.transform("sentences", lambda s: F.right(F.regexp_replace(F.right(T.trim(s), F.lit(3)), "[.!?]", ""), F.lit(2))))
    base = d.select(
        "doc_id", "tokens", lens.alias("lens"), F.size("sentences").alias("ns"), F.size(F.array_distinct(ends)).alias("ends"), F.col("text"), compact.alias("compact"),
        F.size(F.array_distinct("tokens")).alias("types"), hapax("tokens").alias("hapax"), T.round_half_up(moving_types("tokens", window)).alias("mattr"),
    )
    n, k = F.size("tokens"), F.size("lens")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    deviation = F.sqrt((k * squares("lens") - total("lens") * total("lens")).cast("double")) / k
    chars, marks = F.char_length("compact"), F.regexp_count("compact", F.lit(r"[.,!?;:·…\"'()\[\]{}—\-~]"))
    values = {
        "burstiness_cv": F.coalesce(cv("lens"), F.lit(0.0)), "mean_sent_len": share(total("lens"), k), "std_sent_len": F.when(k >= 2, deviation).otherwise(0.0),
        "ttr": share(F.col("types"), n), "mattr": F.coalesce("mattr", F.lit(0.0)), "hapax_ratio": share(F.col("hapax"), F.col("types")),
        "mean_tok_len": share(F.char_length(F.array_join("tokens", "")), n), "comma_per_sent": share(F.regexp_count("text", F.lit("[,，]")), F.col("ns")),
        "punct_ratio": share(marks, chars), "ending_diversity": share(F.col("ends"), F.col("ns")),
        "connective_ratio": share(F.size(F.filter("tokens", lambda t: t.isin(*CONNECTIVES))), n), "digit_ratio": share(F.regexp_count("compact", F.lit("[0-9]")), chars),
    }
    return base.select("doc_id", *[T.round_half_up(values[f]).alias(f) for f in FEATURES])


def longest_run(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """keys, longest_run: the longest stretch of rows in order whose flag holds (0 for none)."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)
    runs = df.withColumn("__g", island).groupBy(*keys, "__g").agg(F.count_if(flag).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_run"))


def longest_stretch(c: str | Column, holds: Callable[[Column], Column]) -> Column:
    """The longest stretch of neighbouring elements of an array for which `holds` is true (0 for none); each row for itself."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        return T.bind(F.when(holds(x), a["now"] + 1).otherwise(0), lambda now: F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best")))

    return F.aggregate(T.col(c), start, step, lambda a: a["best"])


def dominant_class(sentences: DataFrame, keys: list[str], rules: list[tuple[str, str]], share: float = 0.6, least: int = 3) -> DataFrame:
    """keys, n_classed, dominant, share: the class most sentences end in, null under `least` classed sentences or below `share`.

    rules are (class, pattern) in order; the first that matches a sentence decides."""
    named = F.coalesce(*[F.when(F.col("sentence").rlike(p), c) for c, p in rules])
    counts = sentences.withColumn("cls", named).groupBy(*keys).agg(F.count("cls").alias("n_classed"), *[F.count_if(F.col("cls") == c).alias(f"n_{c}") for c, _ in rules])
    best = F.greatest(*[F.struct((F.col(f"n_{c}")).alias("n"), F.lit(c).alias("c")) for c, _ in rules])
    top = counts.withColumn("best", best).withColumn("s", F.try_divide("best.n", "n_classed"))
    ok = (F.col("n_classed") >= least) & (F.col("s") >= share)
    return top.select(*keys, "n_classed", F.when(ok, F.col("best.c")).alias("dominant"), T.round_half_up(F.col("s")).alias("share"))


def style_vector(docs: DataFrame) -> DataFrame:
    """doc_id and six style values; documents with under two sentences or ten tokens are left out."""
    cut = F.transform(F.split("text", r"[.!?。！？\n]+", -1), T.trim)
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))
    cjk = F.split(F.regexp_replace("text", rf"{T.WS}+", ""), "")
    d = docs.select("doc_id", "text", T.non_empty(cut).alias("s"), F.when(F.col("lang").isin("ko", "zh", "ja"), T.non_empty(cjk)).otherwise(words).alias("t"))
    d = d.select("doc_id", "text", F.transform("s", F.char_length).alias("lens"), "t", F.size("t").alias("n")).filter((F.size("lens") >= 2) & (F.col("n") >= 10))
    chars = F.char_length("text")
    out = {
        "mean_len": total("lens") / F.size("lens") / 100, "cv": cv("lens"), "ttr": F.size(F.array_distinct("t")) / F.col("n"), "comma": F.regexp_count("text", F.lit(",")) / chars * 100,
        "marks": F.regexp_count("text", F.lit("[;:—–]")) / chars * 100, "token_len": F.aggregate("t", F.lit(0), lambda a, x: a + F.char_length(x)) / F.col("n") / 10,
    }
    return d.select("doc_id", *[T.round_half_up(v).alias(k) for k, v in out.items()])


def opener_diversity(u: DataFrame) -> DataFrame:
    return u.withColumn("opener_diversity", T.round_half_up(openers("sentences")))


def openers(sentences: str | Column) -> Column:
    first = F.transform(T.col(sentences), lambda s: F.regexp_extract(T.trim(s), rf"\A{T.WS.replace('[', '[^', 1)}*", 0))
    return T.bind(first, lambda o: F.coalesce(F.try_divide(F.size(F.array_distinct(o)), F.size(o)), F.lit(0.0)))


PERSONA = ("burstiness_cv", "mattr", "sentence_opener_diversity", "comma_per_sentence", "suffix_class_diversity", "ko_register_plain_ratio", "ko_register_polite_ratio", "lexicon_density_preferred", "lexicon_density_avoid")


def persona_features(docs: DataFrame, prefer: list[str] = (), avoid: list[str] = (), window: int = 50, unit: str = "paragraph") -> DataFrame:
    """doc_id and the nine persona features, 0 where one can't be worked out.

    Burstiness and moving types are means over paragraphs; openers, commas and Korean registers are of the document's
    sentences; suffix classes of its Korean words; the densities count places of preferred and avoided
    phrases for 1,000 tokens."""
    from lexiscope.operators import korean as K

    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("text", text).select(*UNIT, "text", F.transform(T.split_paragraphs("text", unit), T.prose_sentences).alias("parts"), F.size(T.tokenize("text", F.col("lang"))).alias("nt"), F.col("text").rlike(K.HANGUL).alias("ko"))
    d = d.withColumn("s", document_sentences("text") if unit != "paragraph" else F.flatten("parts"))
    places = lambda words: sum((F.size(F.split("text", f"\\Q{w}\\E", -1)) - 1 for w in words if w), F.lit(0))
    density = lambda words: F.try_divide(places(words) * 1000.0, F.greatest(F.col("nt"), F.lit(1)))
    plain, polite = (F.when(F.col("ko"), c).otherwise(0.0) for c in K.register_ratios("s"))
    whole = {
        "sentence_opener_diversity": openers("s"), "comma_per_sentence": F.try_divide(F.regexp_count("text", F.lit("[,，]")), F.size("s")), "suffix_class_diversity": F.when(F.col("ko"), K.class_diversity("text")),
        "ko_register_plain_ratio": plain, "ko_register_polite_ratio": polite, "lexicon_density_preferred": density(prefer), "lexicon_density_avoid": density(avoid),
    }
    # paragraphs are the document's own, each cut into sentences once
    base = d.select(*UNIT, "parts", *[c.alias(n) for n, c in whole.items()]).select(*UNIT, *whole, F.explode_outer("parts").alias("part"))
    u = cut(base, ["doc_id", "lang", *whole], F.coalesce("part", F.expr("cast(array() as array<string>)")))
    parts = u.select("doc_id", *whole, T.round_half_up(cv("counts")).alias("cv"), T.round_half_up(moving_types("tokens", window)).alias("m"))
    means = parts.groupBy("doc_id").agg(F.avg("cv").alias("burstiness_cv"), F.avg("m").alias("mattr"), *[F.first(n).alias(n) for n in whole])
    return means.select("doc_id", *[T.round_half_up(F.coalesce(n, F.lit(0.0)), 5).alias(n) for n in PERSONA])


def trigger_counts(paras: DataFrame) -> DataFrame:
    """Per document: paragraphs, hot ones, and how many paragraphs each signal and band has."""
    return paras.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"), F.count_if("hot").alias("n_hot"), F.count_if(F.col("cv_band") == "low").alias("cv_low"), F.count_if(F.col("cv_band") == "high").alias("cv_high"),
        F.count_if(F.col("mattr_band") == "low").alias("mattr_low"), F.count_if(F.col("mattr_band") == "high").alias("mattr_high"), F.count_if("lexicon_hot").alias("lexicon_hot"),
    )


def close_runs(counts: Column) -> Column:
    """(a, b), places from 0, of each run of two or more neighbours that differ by under a fifth of the smaller."""

    def runs(c: Column) -> Column:
        apart = lambda i: (i == 0) | ~F.coalesce(F.abs(F.get(c, i) - F.get(c, i - 1)) < 0.2 * F.least(F.get(c, i), F.get(c, i - 1)), F.lit(False))
        places = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        ends = lambda s: F.transform(s, lambda a, n: F.struct(a.alias("a"), (F.coalesce(F.get(s, n + 1), F.size(c)) - 1).alias("b")))
        return T.bind(F.filter(places, apart), lambda s: F.filter(ends(s), lambda r: r["b"] > r["a"]))

    return T.bind(counts, runs)


def sentence_zoom(u: DataFrame, hot: Column) -> DataFrame:
    """Runs of two or more neighbouring sentences of a hot paragraph whose token counts differ by under a fifth of the smaller: doc_id, para_idx, span.

    Each row of u for itself: nothing is joined or shuffled, and a paragraph is cut once."""
    runs = F.when(hot, close_runs(F.col("counts"))).otherwise(F.expr("cast(array() as array<struct<a: int, b: int>>)"))
    x = u.select("doc_id", "para_idx", F.inline(runs))
    return x.select("doc_id", "para_idx", F.format_string("P%d.S%d-S%d", "para_idx", F.col("a") + 1, F.col("b") + 1).alias("span"))


def ngram_redundancy(u: DataFrame, n: int) -> DataFrame:
    """1 - distinct / all n-grams of a unit's lower-case tokens; null without any."""
    # the lower-case tokens are bound: named as a column, Spark would put their expression into the lambda and lower all of them for each n-gram
    grams = lambda low: F.transform(F.sequence(F.lit(1), F.size(low) - n + 1), lambda i: F.array_join(F.slice(low, i, F.lit(n)), " "))
    share = lambda g: T.round_half_up(1 - F.size(F.array_distinct(g)) / F.size(g))
    return u.withColumn("redundancy", T.bind(F.transform("tokens", F.lower), lambda low: F.when(F.size(low) >= n, T.bind(grams(low), share))))
