"""Rule catalogues, discourse tells and lexicons over documents and their units."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions import text as T
from lexiscope.functions.text import round_half_up as r6
from lexiscope.operators import grams as G
from lexiscope.session import materialise

B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # ASCII word borders

#: Leakage rules (id, pattern, needs another rule beside it).
LEAKAGE = (
    ("oai-citation-markup", r"(?i):contentReference|oaicite|oai_citation", False),
    ("model-tool-token", rf"(?i){B}turn\d+(?:search|view|news|image|forecast|finance|fetch)\d*{E}|{B}grok_card{E}", False),
    ("object-replacement-char", "￼", False),
    ("ai-tracking-param", r"(?i)utm_source=(?:chatgpt\.com|openai\.com|perplexity\.ai|claude\.ai|gemini\.google\.com)|[?&](?:ref|utm_source)=chatgpt", False),
    ("explicit-self-identification", rf"(?i){B}as an? (?:AI|artificial intelligence) language model{E}|{B}as a large language model{E}|{B}as a language model,? I{E}|{B}as an AI assistant{E}|{B}I(?: am|'?m) an AI(?:\s+(?:assistant|chatbot|language model|model))?(?:\s+(?:created|developed|trained|designed|built|made)\s+by{E}|(?![-/]|\s+\w))", False),
    ("model-nav-token", rf"(?i){B}navlist{E}", True),
)
#: For each of them, what any match holds in lower case; the patterns are tried on such texts only.
HINTS = (("contentreference", "oaicite", "oai_citation"), ("turn", "grok_card"), ("\ufffc",), ("utm_source=", "=chatgpt"), ("language model", "ai assistant", " an ai"), ("navlist",))
#: Openers that claim candour.
CANDOUR = (r"here'?s the thing", r"here'?s the kicker", r"let'?s be honest", r"let'?s be real", r"the truth is", r"i'?ll be honest(?: with you)?", r"real talk")
CANDOUR_MIN, BREAK_MIN = 2, 3
#: Markdown lines.
BREAK_LINE = r"^[ \t]*(?:-[ \t]*){3,}$|^[ \t]*(?:\*[ \t]*){3,}$|^[ \t]*(?:_[ \t]*){3,}$"
HEADING = r"^[ \t]*#{1,6}[ \t]+\S"
DASHES = r"^[ \t]*(?:-[ \t]*){3,}$"
NO_PARENT = r"^[ \t]*(?:[-*+][ \t]|\d+[.)][ \t]|>)"


def leaks(c: str | Column) -> Column:
    """(rule, m: its matches) of each leakage rule that fires; one that needs company counts only beside another."""
    text = F.coalesce(T.col(c), F.lit(""))

    def hits(low: Column, pattern: str, hints: tuple[str, ...]) -> Column:
        return F.when(reduce(or_, [F.contains(low, F.lit(x)) for x in hints]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr(NONE))

    found = T.bind(F.lower(text), lambda low: F.array(*[F.struct(F.lit(i).alias("rule"), hits(low, p, x).alias("m"), F.lit(company).alias("company")) for (i, p, company), x in zip(LEAKAGE, HINTS, strict=True)]))
    fired = F.filter(found, lambda h: F.size(h["m"]) > 0)
    return T.bind(fired, lambda f: F.filter(f, lambda h: ~h["company"] | F.exists(f, lambda o: ~o["company"])))


def markup_leakage(docs: DataFrame, samples: int = 3) -> DataFrame:
    """doc_id, leaked, n_rules, n_hits, rules, samples (the first distinct ones); a rule that needs company counts only beside another."""
    rows = docs.select("doc_id", leaks("text").alias("h"))
    return rows.select(
        "doc_id", (F.size("h") > 0).alias("leaked"), F.size("h").alias("n_rules"), F.aggregate("h", F.lit(0), lambda a, h: a + F.size(h["m"])).alias("n_hits"),
        F.array_join(F.transform("h", lambda h: h["rule"]), ",").alias("rules"), sample_hits(F.flatten(F.transform("h", lambda h: h["m"])), samples).alias("samples"),
    )


def sample_hits(hits: Column, k: int) -> Column:
    """The first k distinct hits."""
    return F.slice(F.array_distinct(hits), 1, k)


def candour_count(c: str | Column) -> Column:
    # no two of the openers can overlap, so one pass counts them all; their first letters are looked at before the border
    return F.regexp_count(T.col(c), F.lit(rf"(?i)(?=[{''.join(sorted({p[0] for p in CANDOUR}))}]){B}(?:{'|'.join(CANDOUR)}){E}"))


def candour(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", candour_count(F.coalesce("text", F.lit(""))).alias("count")).withColumn("hot", F.col("count") >= CANDOUR_MIN)


def marked(line: Column, blanks: str = " \t") -> Column:
    """Whether the first character after blanks is one that a divider line consists of; the pattern itself is tried at every place of a line."""
    return F.substring(F.ltrim(line, F.lit(blanks)), 1, 1).isin("-", "*", "_")


def break_counts(c: str | Column) -> Column:
    """(count, before_heading) of divider lines that underline no heading and fence no front matter; each row for itself."""
    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("before_heading"))
    blank = lambda x: T.trim(x) == ""
    line = lambda ls, i: F.coalesce(F.get(ls, i), F.lit(""))

    def front_of(ls: Column) -> Column:
        """The line that ends the front matter; -1 without any."""
        opens = F.get(ls, F.lit(0)).rlike(r"^---[ \t]*$") & line(ls, F.lit(1)).rlike(r"^[ \t]*(?:[A-Za-z0-9_.$-]+[ \t]*:(?:\s|$)|- )")
        ends = F.filter(F.sequence(F.lit(2), F.greatest(F.size(ls) - 1, F.lit(2))), lambda j: line(ls, j).rlike(r"^(?:---|\.\.\.)[ \t]*$"))
        return F.when(opens, F.coalesce(F.array_min(ends), F.lit(-1))).otherwise(-1)

    def count(x: Column) -> Column:
        ls, full = x["ls"], x["full"]

        def kept(y: Column) -> Column:
            prev = F.when(y["i"] > 0, line(ls, y["i"] - 1)).otherwise("")
            underline = y["t"].rlike(DASHES) & ~blank(prev) & ~prev.rlike(HEADING) & ~prev.rlike(BREAK_LINE) & ~prev.rlike(NO_PARENT)
            return y["t"].rlike(BREAK_LINE) & (y["i"] > x["front"]) & ~underline

        # a divider is not blank, so the next line with text is its neighbour here
        hits = F.filter(F.transform(full, lambda y, n: F.when(kept(y), line_after(full, n))), lambda h: h.isNotNull())
        return T.bind(hits, lambda h: F.struct(F.size(h).cast("long").alias("count"), F.size(F.filter(h, lambda t: t.rlike(HEADING))).cast("long").alias("before_heading")))

    def line_after(full: Column, n: Column) -> Column:
        return F.coalesce(F.get(full, n + 1)["t"], F.lit(""))

    def look(ls: Column) -> Column:
        full = F.filter(F.transform(ls, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda y: ~blank(y["t"]))
        parts = F.struct(ls.alias("ls"), full.alias("full"), front_of(ls).alias("front"))
        return F.when(F.exists(ls, lambda t: marked(t) & t.rlike(BREAK_LINE)), T.bind(parts, count)).otherwise(none)

    return T.bind(T.split_lines(c), look)


def thematic_breaks(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, count, before_heading, hot: divider lines that underline no heading and fence no front matter."""
    return df.select(*keys, break_counts("text").alias("b")).select(*keys, "b.*", (F.col("b.count") >= BREAK_MIN).alias("hot"))


def divider_only(c: str | Column) -> Column:
    lines = T.non_empty(F.transform(T.split_lines(c), T.trim))
    only = T.bind(lines, lambda ls: (F.size(ls) > 0) & F.forall(ls, lambda x: x.rlike(BREAK_LINE)))
    return F.when(marked(T.col(c), T.BLANKS), only).otherwise(False)  # the first line with text begins where the text does


def short_form_tell(docs: DataFrame, doc_type: str = "social", limit: int = 200, most: int = 4) -> DataFrame:
    """doc_id, eligible, dashes, severity: em dashes outside code and quoted speech in short English social or marketing texts."""
    text = F.coalesce("text", F.lit(""))
    quoted = "[\"“][^\"”\n]*—[^\"”\n]*[\"”]"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), "`[^`\n]*`", " "), quoted, " ")
    n = F.size(F.flatten(F.transform(T.split_paragraphs(text), T.prose_sentences)))
    chars = F.char_length(F.regexp_replace(text, rf"{T.WS}+", ""))
    ok = (F.col("lang") == "en") & F.lit(doc_type in ("social", "marketing")) & (chars <= limit) & n.between(1, most)
    return docs.select("doc_id", ok.alias("eligible"), F.regexp_count(plain, F.lit("—")).alias("dashes")).withColumn("severity", F.when(F.col("eligible"), F.least(F.lit(3), "dashes")).otherwise(0))


TRICOLON = rf"(?i){B}[A-Za-z0-9_'’-]+,\s+[A-Za-z0-9_'’-]+,?\s+(?:and|or)\s+[A-Za-z0-9_'’-]+"
DECOR = r"^#{1,6}\s+\S|^[-*+]\s+\S|^\d+[.)]\s+\S|^(?:-{3,}|\*{3,}|_{3,})$|^\*\*[^*]+\*\*:?$"
ITEM = r"^(?:[-*+]|\d+[.)])\s+\S"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}]"


def tricolon(u: DataFrame) -> DataFrame:
    """Document units -> doc_id, count, hot: three or more sentences with a rule of three, one in four at least."""
    n = F.size(F.filter("sentences", lambda s: s.rlike(TRICOLON)))
    return u.select("doc_id", n.alias("count"), ((n >= 3) & (n >= 0.25 * F.greatest(F.size("sentences"), F.lit(1)))).alias("hot"))


def decorative(docs: DataFrame) -> DataFrame:
    lines = T.non_empty(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), T.trim))
    n, k = F.size(lines), F.size(F.filter(lines, lambda x: x.rlike(DECOR)))
    return docs.select("doc_id", n.alias("lines"), k.alias("decorative"), ((n >= 8) & (k >= 0.5 * n)).alias("hot"))


def emoji_items(docs: DataFrame) -> DataFrame:
    items = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), T.trim), lambda x: x.rlike(ITEM))
    n, k = F.size(items), F.size(F.filter(items, lambda x: x.rlike(EMOJI)))
    return docs.select("doc_id", n.alias("items"), k.alias("with_emoji"), ((n >= 3) & (k >= 3) & (k >= 0.6 * n)).alias("hot"))


# --- lexicons --------------------------------------------------------------------------------


def phrase_regex(c: Column) -> Column:
    """A phrase as a pattern: `~` stands for up to 40 characters, spaces for any white space."""
    one = F.regexp_replace(F.lower(c), r"~(?:\s*~)+", "~")
    escaped = F.regexp_replace(one, r"([.*+?^$\{\}()|\[\]\\\\])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(escaped, r"\s+", r"\\s+"), "~", r"[\\s\\S]{0,40}")


#: Words, and patterns, of a language that a row can hold as a list; a lexicon with more goes by a join.
LISTED = 2000
NONE = "cast(array() as array<string>)"


def listed_or_not(entries: DataFrame, listed: int) -> bool:
    """Whether a language has more entries than a list may hold."""
    return (entries.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > listed


def matched(u: DataFrame, lexicon: DataFrame, keys: list[str], name: str = "entries", listed: int = LISTED) -> DataFrame:
    """u with the distinct lexicon entries of each unit, each at most once. lexicon(lang, kind: strict or phrase, entry).

    Single words match by token, with -s and -ing forms outside Chinese, Japanese and Korean. Phrases,
    entries of several words, and entries of those languages are tested by pattern. A lexicon of
    editorial size meets the units as one row of lists for each language, and nothing is shuffled; a larger
    one meets their tokens in a hash join on (lang, token). Likewise patterns: a short list is tried on each text,
    of a long one only those whose rarest run of characters a text has (grams.candidates)."""
    cjk = F.col("lang").isin("ko", "zh", "ja")
    word = (F.col("kind") == "strict") & ~cjk & ~F.col("entry").rlike(r"[^\p{L}\p{N}]")
    low = F.lower("entry")
    quoted = F.regexp_replace(F.regexp_replace(low, r"([.*+?^$\{\}()|\[\]\\\\])", r"\\$1"), r"\s+", r"\\s+")
    pattern = F.when(F.col("kind") == "phrase", phrase_regex(F.col("entry"))).when(cjk, quoted).otherwise(F.concat(F.lit("(?="), quoted, F.lit(r")(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")))  # the words are looked for first, as few places have them
    forms = F.array(low, F.concat(low, F.lit("s")), F.concat(low, F.lit("ing")))
    lexicon = lexicon.distinct().withColumns({"forms": F.when(word, forms), "p": F.when(~word, pattern)})
    lists = materialise(lexicon.groupBy("lang").agg(
        F.collect_list(F.when(F.col("forms").isNotNull(), F.struct("entry", "forms"))).alias("words"), F.collect_list(F.when(F.col("p").isNotNull(), F.struct("entry", "p"))).alias("ps")
    ).withColumn("every", F.array_distinct(F.flatten("words.forms"))))
    most = lists.agg(F.max(F.size("words")).alias("words"), F.max(F.size("ps")).alias("ps")).first()
    large, many_patterns = (most["words"] or 0) > listed, (most["ps"] or 0) > listed
    tokens = F.array_distinct(F.transform("tokens", F.lower))
    text = F.lower("text")
    if large:
        lists = lists.withColumns({"words": F.slice("words", 1, 0), "every": F.slice("every", 1, 0)})
    if many_patterns:
        lists = lists.withColumn("ps", F.filter("ps", lambda x: F.regexp_replace(x["entry"], r"[~\s]+", "") == ""))  # what has no character to go by
    # all patterns of a language as one: most texts match none of them, and Spark keeps a pattern that the row before had, too
    lists = lists.withColumn("any", F.when(F.size("ps") > 0, F.array_join(F.transform("ps", lambda p: F.concat(F.lit("(?:"), p["p"], F.lit(")"))), "|")))
    rows = u.join(lists, "lang", "left")
    single = T.bind(F.array_intersect(F.transform("tokens", F.lower), "every"), lambda hit: F.when(F.size(hit) > 0, F.transform(F.filter("words", lambda w: F.arrays_overlap(w["forms"], hit)), lambda w: w["entry"])).otherwise(F.expr(NONE)))
    tried = lambda low: F.transform(F.filter("ps", lambda p: F.regexp_like(low, p["p"])), lambda p: p["entry"])
    many = T.bind(text, lambda low: F.when(F.regexp_instr(low, F.col("any")) > 0, tried(low)).otherwise(F.expr(NONE)))
    found = F.coalesce(F.array_union(single, many), F.expr("cast(array() as array<string>)"))
    out = rows.withColumn(name, found).select(*u.columns, name)
    more = f"more {name}"
    if large:
        by_token = lexicon.filter("forms is not null").select("lang", "entry", F.explode("forms").alias("token"))
        hits = u.select(*keys, "lang", F.explode(tokens).alias("token")).join(by_token, ["lang", "token"]).groupBy(*keys).agg(F.collect_set("entry").alias(more))
        out = out.join(hits, keys, "left").withColumn(name, F.array_union(name, F.coalesce(F.col(more), F.expr(NONE)))).select(*u.columns, name)
    if many_patterns:
        pieces = F.array_distinct(T.non_empty(F.split(low, r"[~\s]+", -1)))
        literals = lexicon.filter("p is not null").select("lang", "entry", "p", pieces.alias("pieces")).dropDuplicates(["lang", "entry", "p"])
        # a strict entry and a phrase of the same words are two patterns
        literals = literals.withColumns({"name": F.col("entry"), "entry": F.concat("entry", F.lit(" "), F.col("p"))})
        met = G.candidates(u.select(*keys, "lang", text.alias("low")), keys, "low", literals).groupBy(*keys).agg(F.collect_set(F.struct("name", "p")).alias(more))
        held = F.transform(F.filter(F.col(more), lambda x: F.regexp_like(text, x["p"])), lambda x: x["name"])
        out = out.join(met, keys, "left").withColumn(name, F.array_union(name, F.coalesce(held, F.expr(NONE)))).select(*u.columns, name)
    return out


def match_terms(u: DataFrame, lexicon: DataFrame, keys: list[str], listed: int = LISTED) -> DataFrame:
    """keys, entry: a row for each entry of each unit."""
    # an inner explode would be given a filter that matches each unit once more
    return matched(u, lexicon, keys, "entries", listed).select(*keys, F.explode_outer("entries").alias("entry")).filter("entry is not null")


def density_of(matches: Column, tokens: Column, threshold: float = 3.0) -> tuple[Column, Column]:
    """(matches for 1,000 tokens, hot: over the threshold with one match, two for Chinese, Japanese, Korean)."""
    density = F.coalesce(F.try_divide(matches * 1000.0, tokens), F.lit(0.0))
    least = F.when(F.col("lang").isin("ko", "zh", "ja"), 2).otherwise(1)
    return r6(density), (matches >= least) & (density > threshold)


def lexicon_density(u: DataFrame, lexicon: DataFrame, keys: list[str], threshold: float = 3.0) -> DataFrame:
    """keys, matches, density (per 1,000 tokens), lexicon_hot: over the threshold with one match, two for Chinese, Japanese, Korean."""
    j = matched(u, lexicon, keys).withColumn("matches", F.size("entries").cast("long"))
    density, hot = density_of(F.col("matches"), F.size("tokens"), threshold)
    return j.select(*keys, "matches", density.alias("density"), hot.alias("lexicon_hot"))


def watch_hits(docs: DataFrame, terms: DataFrame, listed: int = LISTED) -> DataFrame:
    """doc_id, hits: how many of the language's watch terms a text contains. A long list goes by an index of the terms; doc_ids are then distinct."""
    terms = terms.filter("term is not null").select("lang", F.lower("term").alias("entry")).distinct()
    text = F.lower(F.coalesce("text", F.lit("")))
    if not listed_or_not(terms, listed):
        lists = terms.groupBy("lang").agg(F.collect_list("entry").alias("ts"))
        return docs.join(lists, "lang", "left").select("doc_id", F.coalesce(F.size(F.filter("ts", lambda t: F.contains(text, t))), F.lit(0)).alias("hits"))
    met = G.candidates(docs.select("doc_id", "lang", text.alias("low")), ["doc_id"], "low", terms.withColumn("pieces", F.array("entry")))
    found = met.groupBy("doc_id").agg(F.collect_set("entry").alias("ts"))
    empty = terms.filter("entry = ''").select("lang", F.lit(1).alias("bare"))  # the empty term is in every text
    x = docs.join(found, "doc_id", "left").join(empty, "lang", "left")
    return x.select("doc_id", (F.coalesce(F.size(F.filter("ts", lambda t: F.contains(text, t))), F.lit(0)) + F.coalesce("bare", F.lit(0))).alias("hits"))


def term_coverage(phrases: DataFrame, terms: DataFrame, listed: int = LISTED) -> DataFrame:
    """phrases(lang, phrase), terms(lang, term) -> lang, n, covered: the phrase is a term or contains one of three characters or more."""
    terms = terms.filter("term is not null").select("lang", F.lower("term").alias("entry")).distinct()
    p = F.lower("phrase")
    if not listed_or_not(terms, listed):
        lists = terms.groupBy("lang").agg(F.collect_list("entry").alias("ts"))
        hit = F.exists("ts", lambda t: (t == p) | ((F.char_length(t) >= 3) & F.contains(p, t)))
        return phrases.join(lists, "lang", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("covered"))
    x = materialise(phrases.select("lang", p.alias("low"), F.monotonically_increasing_id().alias("row")))
    met = G.candidates(x, ["row"], "low", terms.filter(F.char_length("entry") >= 3).withColumn("pieces", F.array("entry"))).groupBy("row").agg(F.collect_set("entry").alias("ts"))
    short = terms.filter(F.char_length("entry") < 3).select("lang", F.col("entry").alias("low"), F.lit(True).alias("same"))
    y = x.join(met, "row", "left").join(short, ["lang", "low"], "left")
    hit = F.coalesce(F.exists("ts", lambda t: F.contains("low", t)), F.lit(False)) | F.coalesce("same", F.lit(False))
    return y.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(hit).alias("covered"))


def lexicon_lift(docs: DataFrame, entries: DataFrame, lift: float = 4.0, cold_rate: float = 0.05) -> DataFrame:
    """docs(doc_id, hot, tokens), entries(entry) -> entry, hot_docs, cold_docs, lift (null: endless), keep."""
    total = docs.agg(F.count_if("hot").alias("h"), F.count_if(~F.col("hot")).alias("c"))
    tokens = docs.select("doc_id", "hot", F.explode(F.array_distinct(F.transform("tokens", F.lower))).alias("entry"))
    seen = tokens.groupBy("entry").agg(F.count_if("hot").alias("hot_docs"), F.count_if(~F.col("hot")).alias("cold_docs"))
    x = entries.join(seen, "entry", "left").na.fill(0, ["hot_docs", "cold_docs"]).crossJoin(F.broadcast(total))  # total is one row
    hr, cr = F.try_divide(F.col("hot_docs").cast("double"), "h"), F.try_divide(F.col("cold_docs").cast("double"), "c")
    x = x.withColumns({"lift": r6(F.when(F.col("cold_docs") > 0, F.try_divide(hr, cr)), 4), "cold": F.coalesce(cr, F.lit(0.0))})
    return x.select("entry", "hot_docs", "cold_docs", "lift", ((F.col("hot_docs") > 0) & (F.col("lift").isNull() | (F.col("lift") >= lift)) & (F.col("cold") <= cold_rate)).alias("keep"))


def lift_readiness(docs: DataFrame, least: int = 25, registers: int = 2) -> DataFrame:
    """One row: whether each class has enough documents and registers to mine from."""
    x = docs.agg(F.count_if("hot").alias("hot_docs"), F.count_if(~F.col("hot")).alias("cold_docs"), F.count_distinct(F.when(F.col("hot"), F.col("source"))).alias("hot_registers"), F.count_distinct(F.when(~F.col("hot"), F.col("source"))).alias("cold_registers"))
    return x.withColumn("ready", (F.least("hot_docs", "cold_docs") >= least) & (F.least("hot_registers", "cold_registers") >= registers))
