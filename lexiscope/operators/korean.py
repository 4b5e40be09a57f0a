"""Korean measures: spacing, suffix classes, sentence endings, register, and the calque catalogue."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.functions.text import round_half_up as r6
from lexiscope.operators.style import cv, mattr, total

HANGUL = r"[ㄱ-ㆎ가-힣]"
#: Suffix classes; of several suffixes that fit, the longest counts.
SUFFIXES = {
    "quote": ("라고", "이라고"), "source": ("에게서", "한테서", "으로부터", "로부터"), "instrument": ("으로써", "로써"), "standard": ("으로서", "로서"), "topic": ("은", "는"), "subject": ("이", "가", "께서"),
    "object": ("을", "를"), "genitive": ("의",), "location": ("에서", "에게", "한테", "께", "에"), "direction": ("으로", "로"), "conjunction": ("와", "과", "하고", "랑"), "additive": ("도", "또한"),
    "delimiter": ("만", "까지", "부터", "마다"), "comparison": ("보다", "처럼"), "formal_ending": ("습니다", "습니까", "합니다", "합니까", "입니다"), "polite_ending": ("어요", "아요", "예요", "이에요", "네요", "군요", "지요"),
    "casual_ending": ("죠", "네", "군"), "declarative_ending": ("한다", "된다", "했다", "였다", "이다", "있다", "없다"),
}
#: Sentence endings by style.
FORMAL = ("습니다", "습니까", "합니다", "합니까", "입니다")
POLITE = ("어요", "아요", "예요", "이에요", "네요", "군요", "지요", "죠")
PLAIN = ("한다", "된다", "했다", "였다", "이다", "있다", "없다", "왔다", "봤다", "다")
FUSED = "ㅂ니다"


def alternation(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def eojeols(c: str | Column) -> Column:
    """White-space words with a Hangul letter, edge punctuation off."""
    return F.filter(T.tokenize(c), lambda w: w.rlike(HANGUL))


def lengths(e: Column) -> Column:
    return F.filter(F.transform(e, lambda w: F.char_length(F.regexp_replace(w, HANGUL.replace("[", "[^"), ""))), lambda n: n > 0)


def spacing_profile(u: DataFrame) -> DataFrame:
    """Adds eojeols, mean and variation of their Hangul length, shares of one syllable and of seven or more."""
    x = u.withColumn("ko_lens", lengths(eojeols("text")))
    n = F.size("ko_lens")
    share = lambda f: r6(F.try_divide(F.size(F.filter("ko_lens", f)), n))
    return x.withColumns({"eojeols": n, "mean_length": r6(F.try_divide(total("ko_lens"), n)), "length_cv": r6(cv("ko_lens")), "single_share": share(lambda v: v == 1), "long_share": share(lambda v: v >= 7)}).drop("ko_lens")


def suffix_of(word: Column) -> Column:
    """The longest suffix that ends a longer word; empty if none."""
    return F.regexp_extract(word, rf"^.+?({alternation(s for g in SUFFIXES.values() for s in g)})$", 1)


def class_diversity(c: str | Column) -> Column:
    """Classes of known suffixes for each eojeol that ends in one; null without any."""
    classes = F.create_map(*[F.lit(x) for g, words in SUFFIXES.items() for w in words for x in (w, g)])
    kinds = F.filter(F.transform(eojeols(c), lambda w: F.element_at(classes, suffix_of(w))), lambda k: k.isNotNull())
    return F.when(T.col(c).rlike(HANGUL), T.bind(kinds, lambda k: F.try_divide(F.size(F.array_distinct(k)), F.size(k))))


def register_ratios(sentences: str | Column) -> tuple[Column, Column]:
    """(plain, polite and formal) shares of classified sentence ends: to two digits over three or more Korean ones, else of all sentences' last words."""
    own = F.filter(T.col(sentences), lambda s: s.rlike(HANGUL))  # no other sentence is classified
    kinds = F.transform(F.transform(own, lambda s: F.try_element_at(eojeols(s), F.lit(-1))), kind_of)
    words = F.transform(F.transform(own, lambda s: F.element_at(F.split(F.regexp_replace(T.trim(s), LAST_MARKS, ""), rf"{T.WS}+", -1), -1)), kind_of)
    named = F.struct(F.filter(kinds, lambda k: k.isNotNull()).alias("k"), F.filter(words, lambda k: k.isNotNull()).alias("w"))
    many = lambda a, *names: F.size(F.filter(a, lambda v: v.isin(*names)))

    def both(x: Column) -> Column:
        k, w = x["k"], x["w"]
        two = lambda name: r6(F.try_divide(many(k, name), F.size(k)), 2)
        exact = lambda *names: F.coalesce(F.try_divide(many(w, *names), F.size(w)), F.lit(0.0))
        return F.when(F.size(k) >= 3, F.struct(two("plain").alias("plain"), (two("polite") + two("formal")).alias("polite"))).otherwise(F.struct(exact("plain").alias("plain"), exact("polite", "formal").alias("polite")))

    out = T.bind(named, both)
    return out["plain"], out["polite"]


def suffix_profile(u: DataFrame) -> DataFrame:
    """Adds how many eojeols end in a known suffix and the diversity of its classes and forms."""
    found = F.filter(F.transform(eojeols("text"), suffix_of), lambda s: s != "")
    classes = F.create_map(*[F.lit(x) for g, words in SUFFIXES.items() for w in words for x in (w, g)])
    x = u.withColumn("__s", found)
    kinds = F.size(F.array_distinct(F.transform("__s", lambda s: F.element_at(classes, s))))
    return x.withColumns({"suffixes": F.size("__s"), "class_diversity": r6(F.try_divide(kinds, F.size("__s"))), "suffix_diversity": r6(F.try_divide(F.size(F.array_distinct("__s")), F.size("__s")))}).drop("__s")


def low_strength(value: Column, threshold: float) -> Column:
    return F.when(value <= threshold, (1 - value / threshold) * 100).otherwise(0.0)


def diagnostics(u: DataFrame, sentences: int = 4, words: int = 20) -> DataFrame:
    """Adds diagnostic_hot and diagnostic_strength: even spacing, few commas and few suffix classes together; strength is the weakest of the three."""
    x = suffix_profile(spacing_profile(u))
    n = F.size("sentences")
    commas = F.try_divide(F.regexp_count("text", F.lit("[,，、]")), n)
    parts = [low_strength(F.col("length_cv"), 0.38), low_strength(commas, 1.0), F.when(F.col("suffixes") >= 10, low_strength(F.col("class_diversity"), 0.26)).otherwise(0.0)]
    least = F.least(*[F.coalesce(p, F.lit(0.0)) for p in parts])
    hot = (F.col("lang") == "ko") & (n >= sentences) & (F.col("eojeols") >= words) & (least > 0)
    return x.withColumns({"diagnostic_hot": hot, "diagnostic_strength": F.when(hot, r6(least, 4)).otherwise(0.0)})


def sentence_ending(c: str | Column) -> Column:
    """The ending of a sentence's last eojeol; a formal one fused into its stem (a final ㅂ before 니다 or 니까) reads ㅂ니다; null if none fits."""
    last = F.try_element_at(eojeols(c), F.lit(-1))
    found = F.regexp_extract(last, f"({alternation({*FORMAL, *POLITE, *PLAIN})})$", 1)
    stem = F.regexp_extract(last, "(.)(?:니다|니까)$", 1)
    fused = stem.rlike("^[가-힣]$") & ((F.ascii(stem) - 44032) % 28 == 17)
    return F.when(last.isNull(), None).when(found.isin("", "다") & F.coalesce(fused, F.lit(False)), FUSED).when(found != "", found)


def endings(u: DataFrame) -> Column:
    return F.filter(F.transform("sentences", sentence_ending), lambda e: e.isNotNull())


def ending_monotony(u: DataFrame) -> DataFrame:
    """Adds plain_count, plain_share and ending_hot: six of ten endings plain, two at least, twenty tokens, even sentence lengths."""
    x = u.withColumn("__e", endings(u))
    plain = F.size(F.filter("__e", lambda e: e.isin(*PLAIN)))
    x = x.withColumns({"plain_count": plain, "plain_share": r6(F.try_divide(plain, F.size("__e")))}).drop("__e")
    hot = (F.col("lang") == "ko") & (F.size("tokens") >= 20) & (cv("counts") < 0.30) & (F.col("plain_share") >= 0.6) & (F.col("plain_count") >= 2)
    return x.withColumn("ending_hot", F.coalesce(hot, F.lit(False)))


LAST_MARKS = r"[.!?…\"'」』)\]]+$"


def kind_of(w: Column) -> Column:
    """The register that a sentence's last word tells: formal, polite, plain or null."""
    return F.when(w.rlike("(?:니다|니까)$"), "formal").when(w.rlike("[요죠]$"), "polite").when(w.rlike("다$"), "plain")


def signals(u: DataFrame) -> DataFrame:
    """Adds diagnostic_hot, diagnostic_strength and ending_hot to units with their cv; texts of other languages are not looked at."""
    ko = F.col("lang") == "ko"
    x = u.withColumns({"__text": F.col("text"), "__sentences": F.col("sentences"), "text": F.when(ko, F.col("text")), "sentences": F.when(ko, F.col("sentences"))})
    x = ending_monotony(diagnostics(x))
    x = x.withColumns({"text": F.col("__text"), "sentences": F.col("__sentences"), "diagnostic_hot": F.coalesce("diagnostic_hot", F.lit(False)), "diagnostic_strength": F.coalesce("diagnostic_strength", F.lit(0.0))})
    return x.select(*u.columns, "diagnostic_hot", "diagnostic_strength", "ending_hot")


def register(u: DataFrame) -> DataFrame:
    """doc_id, classified, register: formal, polite or plain if six of ten classified endings agree, else mixed; null under three."""
    last = F.transform("sentences", lambda s: F.try_element_at(eojeols(s), F.lit(-1)))
    x = u.withColumn("__k", F.filter(F.transform(last, kind_of), lambda k: k.isNotNull()))
    n = F.size("__k")
    def many(name: str) -> Column:
        return F.size(F.filter("__k", lambda v: v == name)) >= 0.6 * n

    out = F.when(many("formal"), "formal").when(many("polite"), "polite").when(many("plain"), "plain")
    return x.select("doc_id", n.alias("classified"), F.when(n >= 3, out.otherwise("mixed")).alias("register"))


PASSIVE = "(?:된다|된|될|됨|됐다|됐|돼|되었|되어|되는|되며|되고|됩니다|됩|받는다|받았다|받은|받을|받는|받습니다|받아|당한다|당했다|당하다|당하는|당해|(?:어|아|여)(?:진다|졌다|진|질|지는|집니다|져))"
#: Calque rules (id, strong, least matches, pattern), in their order.
RULES = (
    ("noun-calque", True, 1, "커맨드 기둥|명령(?:어)? 기둥|기둥 커맨드|[가-힣]{1,32} 레이어로서"),
    ("dummy-subject", True, 1, r"(?:^|[.!?。]\s+|\n)\s*(?:그것은|이것은|그것이|이것이)\s"),
    ("direct-address-you", True, 1, "(?<![가-힣])당신(?:은|이|의|에게|을|를|께서|께)?(?![가-힣])"),
    ("a16-pronoun-literal", True, 1, "(?<![가-힣])(?:(?:그녀|그것|그들)[은는이가을를의도만와과랑에게한테께서처럼보다마저조차까지부터로으요]{0,4}|그(?:는|가|를|의|에게|와|도|만))(?![가-힣])"),
    ("a19-double-particle", True, 1, "(?:에서의|에로의|으로의|에의|으로부터의|로부터의)"),
    ("passive-e-uihae", False, 1, r"에\s*의(?:해|하여)"),
    ("t2-by-passive", True, 1, r"에\s*의(?:해|하여)\s+\S{0,12}?" + PASSIVE),
    ("a8-double-passive", True, 1, "(?:되어진다|되어졌다|되어진|되어지는|보여진다|보여졌다|보여진|쓰여진다|쓰여졌다|쓰여진|잊혀진|잊혀졌|닫혀진|열려진|불려진|놓여진)"),
    ("have-overuse", False, 1, r"(?:을|를)\s*(?:가지(?:고 있|고 있습니다|고 있다)|갖(?:고 있|고 있습니다|고 있다))"),
    ("a7-light-verb", False, 1, r"(?:회의를\s*가(?:지|졌)|결정을\s*내(?:리|렸)|(?:을|를)\s*갖고\s*있(?:다|습니다|는|었|으)?)"),
    ("one-of", False, 1, r"중\s*하나(?:이다|입니다|인|로|다|예요)?"),
    ("provides", False, 1, r"(?:을|를)\s*제공(?:합니다|한다|해 줍니다|해준다)"),
    ("as-follows", False, 1, r"다음과\s*같(?:습니다|다|은|이)"),
    ("make-easy", False, 1, r"(?:쉽게|가능하게|간단하게|편하게)\s*(?:만들어\s*(?:줍니다|준다|줘)|만듭니다|만든다)"),
    ("c11-connective-comma", False, 2, r"(?:며|지만|면서|아서|어서)\s*,|(?<![참광사신경충권예공원최중창재])고\s*,"),
)
PROGRESSIVE = r"고\s*있(?:다|습니다|는|었|으|고|지|기)?"
RELATIVE = r"[가-힣]{1,12}(?:하는|되는|받는|받은|쓰인|되어진|보여진|한|할|된|될|던|운|온|인|힌|진|린|킨|쓴)\s+[가-힣]{1,12}"


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """Korean docs(doc_id, lang, text) -> doc_id, rule, strong, start, end, text of each match, of rules that match often enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(i, s, n, re.compile(p)) for i, s, n, p in rules]
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                for i, strong, least, p in compiled:
                    found = [(doc, i, strong, m.start(), m.end(), m.group()) for m in p.finditer(text)]
                    rows += found if len(found) >= least else []
            yield pd.DataFrame(rows, columns=["doc_id", "rule", "strong", "start", "end", "text"])

    own = docs.filter("lang = 'ko' and text is not null").select("doc_id", "text")
    return own.mapInPandas(run, "doc_id long, rule string, strong boolean, start int, end int, text string")


def independent_hits(hits: DataFrame) -> DataFrame:
    """Of a document's hits, those kept when strong ones, then longer, then earlier ones take their characters first. A group is one document's hits."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        order = g.assign(n=g["start"] - g["end"]).sort_values(["strong", "n", "start"], ascending=[False, True, True])
        used, kept = bytearray(int(g["end"].max())), []
        for i, s, e in zip(order.index, order["start"], order["end"], strict=True):
            if not any(used[s:e]):
                used[s:e] = b"\x01" * (e - s)
                kept.append(i)
        return g.loc[sorted(kept)]

    return hits.groupBy("doc_id").applyInPandas(pick, hits.schema)


def translationese(u: DataFrame, docs: DataFrame) -> DataFrame:
    """Document units and docs -> doc_id, count, strong, density (per sentence), hot: four independent hits, one for two sentences, a strong one among them."""
    g = independent_hits(apply_rules(docs)).groupBy("doc_id").agg(F.count("*").alias("count"), F.count_if("strong").alias("strong"))
    x = u.select("doc_id", F.greatest(F.size("sentences"), F.lit(1)).alias("n")).join(g, "doc_id", "left").na.fill(0, ["count", "strong"])
    return x.select("doc_id", "count", "strong", r6(F.col("count") / F.col("n"), 3).alias("density"), ((F.col("count") >= 4) & (F.col("count") >= 0.5 * F.col("n")) & (F.col("strong") >= 1)).alias("hot"))


def post_edit_profile(u: DataFrame, keys: list[str]) -> DataFrame:
    """Korean units (documents or paragraphs) -> keys and four structs: lexical, endings, interference, rhythm."""
    own = u.filter("lang = 'ko'").withColumns({"w": eojeols("text"), "e": endings(u)}).filter(F.size("w") > 0)
    x = suffix_profile(spacing_profile(own))
    m = mattr(x.select(*keys, F.col("w").alias("tokens")), keys, 50).select(*keys, "mattr")
    x = x.join(m, keys)
    n, k = F.size("sentences"), F.size("e")
    share = lambda a, b: r6(F.try_divide(a, b))
    many = lambda names: F.size(F.filter("e", lambda v: v.isin(*names)))
    run = F.aggregate("e", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, v: F.struct(F.when(v.isin(*PLAIN), a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["best"], F.when(v.isin(*PLAIN), a["now"] + 1).otherwise(0)).alias("best")), lambda a: a["best"])
    types = F.size(F.array_distinct(F.transform("w", F.lower)))
    per_sentence = F.filter(F.transform("sentences", lambda s: F.size(eojeols(s))), lambda v: v > 0)
    commas = F.regexp_count("text", F.lit("[,，、]"))
    by_rule = {i: F.regexp_count("text", F.lit(p)) for i, _, _, p in RULES}
    return x.withColumn("__c", per_sentence).select(
        *keys,
        F.struct(F.size("w").alias("tokens"), types.alias("types"), share(types, F.size("w")).alias("ttr"), F.col("mattr"), F.size(F.array_distinct("e")).alias("ending_types"), share(F.size(F.array_distinct("e")), n).alias("ending_diversity")).alias("lexical"),
        F.struct(many(PLAIN).alias("plain"), share(many(PLAIN), k).alias("plain_share"), many(("한다",)).alias("handa"), many(("된다",)).alias("doenda"), many(("이다",)).alias("ida"), many((*FORMAL, FUSED)).alias("formal"), many(POLITE).alias("polite"), run.alias("plain_streak")).alias("endings"),
        F.struct(by_rule["a16-pronoun-literal"].alias("pronouns"), by_rule["a19-double-particle"].alias("double_particles"), F.regexp_count("text", F.lit(PROGRESSIVE)).alias("progressives"), by_rule["a7-light-verb"].alias("light_verbs"), by_rule["passive-e-uihae"].alias("by_passives"), by_rule["a8-double-passive"].alias("double_passives"), by_rule["c11-connective-comma"].alias("connective_commas"), F.regexp_count("text", F.lit(RELATIVE)).alias("relative_clauses")).alias("interference"),
        F.struct(share(F.size("w"), n).alias("sentence_words"), r6(cv("__c")).alias("sentence_cv"), F.col("mean_length"), F.col("length_cv"), share(commas, n).alias("commas_per_sentence"), share(commas * 100, F.char_length(F.regexp_replace("text", rf"{T.WS}+", ""))).alias("commas_per_100"), F.col("suffixes"), F.col("class_diversity"), F.col("suffix_diversity")).alias("rhythm"),
    )
