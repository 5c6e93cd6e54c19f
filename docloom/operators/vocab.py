"""Transcripts: segments, vocabulary and phrases, and records parsed from notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import blocks as md
from docloom.functions import markdown
from docloom.operators.lookups import small
from docloom.operators.report import top_k
from docloom.sources.io import stored

SENTENCE = r"(?<=[.!?])\s+"
WORDS = r"[^\p{L}]+"


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of each text with their number, without the white space between them; a null text has none."""
    return docs.select(key, F.posexplode(F.split(text, SENTENCE)).alias("seg_no", "segment"))


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000) -> DataFrame:
    """Each text cut between sentences into segments of up to ``most`` characters; joined, they are the text.

    A segment takes as many sentences as fit.  White space after a sentence begins the
    next one; a sentence longer than ``most`` is a segment by itself.  An empty text has one
    empty segment, a null text none.
    """
    lengths = F.transform(F.split(text, r"(?<=[.!?])(?=\s)"), lambda s: F.length(s))
    none = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("begin"), F.lit(0).alias("end"))

    def fold(held: Column, n: Column) -> Column:
        full = (held["end"] + n - held["begin"] > most) & (held["end"] > held["begin"])
        return F.struct(F.when(full, F.concat(held["starts"], F.array(held["end"]))).otherwise(held["starts"]).alias("starts"), F.when(full, held["end"]).otherwise(held["begin"]).alias("begin"), (held["end"] + n).alias("end"))

    starts = F.aggregate(lengths, none, fold, lambda held: held["starts"])
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), starts.alias("_starts"))
    cuts = rows.select(key, "_text", "_starts", F.posexplode("_starts").alias("seg_no", "_at"))
    stop = F.coalesce(F.get("_starts", F.col("seg_no") + 1), F.length("_text"))
    return cuts.select(key, "seg_no", F.substring("_text", F.col("_at") + 1, stop - F.col("_at")).alias("segment"))


#: Characters of text whose words a task counts, on average, and words whose numbers of documents every task gets.
PART_CHARS, OFTEN = 16_000_000, 50_000


def key_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 15, shortest: int = 4) -> DataFrame:
    """The ``k`` words of each document with the highest tf-idf (rounded to 6 places, ties by word) and ``seg_no``, the first sentence with each.

    Texts are dealt by document into parts of a bounded size, where words are counted and ranked.
    The numbers of documents of the most frequent words go to all tasks, so only rare words,
    each in few documents, are shuffled.
    """
    parts = max(4 * docs.sparkSession.sparkContext.defaultParallelism, (docs.agg(F.sum(F.length(text))).first()[0] or 0) // PART_CHARS + 1)
    placed = sentences(docs.select(key, text).repartition(parts, key), key, text)
    words = placed.select(key, "seg_no", F.explode(F.split(F.lower("segment"), WORDS)).alias("word")).where(F.length("word") >= shortest)
    tf = words.groupBy(key, "word").agg(F.count("*").alias("tf"), F.min("seg_no").alias("seg_no"))
    df = stored(tf.groupBy("word").agg(F.count("*").alias("df")), "word-docs")
    n = docs.count()
    often = stored(df.orderBy(F.desc("df"), "word").limit(OFTEN), "frequent-words")
    score = F.round(F.col("tf") * F.log(1 + F.lit(n) / F.col("df")), 6).alias("score")
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "word")
    # ranked where they were counted, but for rare words, which have no score yet
    met = tf.join(small(often), "word", "left").select(key, "word", "tf", "seg_no", score).withColumn("rank", F.row_number().over(order))
    met = stored(met.where(F.col("score").isNull() | (F.col("rank") <= k)), "key-words")
    rare = met.where("score IS NULL").drop("score").join(df, "word").select(key, "word", score, "seg_no")
    return top_k(met.where("score IS NOT NULL").select(key, "word", "score", "seg_no").unionByName(rare), [key], [F.desc("score"), F.asc("word")], k)


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 15, shortest: int = 4) -> DataFrame:
    """``key_words`` with the first sentence of each as ``context``."""
    best = key_words(docs, key=key, text=text, k=k, shortest=shortest)
    return best.join(sentences(docs, key, text), [key, "seg_no"]).select(key, "word", "score", "rank", F.col("segment").alias("context"))


def phrases(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 2, k: int = 10) -> DataFrame:
    """The ``k`` most frequent word n-grams of each document, ties by phrase."""
    # a document's texts meet in one row, so its n-grams are counted there, sorted, and never shuffled
    told = docs.groupBy(key).agg(F.collect_list(text).alias("texts"))
    words = F.transform("texts", lambda t: F.filter(F.split(F.lower(t), WORDS), lambda w: w != ""))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    each = F.flatten(F.transform(F.filter(words, lambda w: F.size(w) >= n), grams))
    # generators of one row keep the optimizer from sorting anew at each use
    rows = told.select(key, F.inline(F.array(F.struct(F.array_sort(each).alias("s"))))).where(F.size("s") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.select(key, "s", F.inline(F.array(F.struct(first.alias("at")))))
    counts = F.transform("at", lambda a, j: F.struct((a - F.coalesce(F.get("at", j + 1), F.size("s"))).cast("long").alias("less"), F.get("s", a).alias("phrase")))
    best = rows.select(key, F.posexplode(F.slice(F.array_sort(counts), 1, k)).alias("rank", "c"))
    return best.select(key, "c.phrase", (-F.col("c.less")).alias("uses"), (F.col("rank") + 1).alias("rank"))


# What notes call the parts of a record, in English and in the reference language of the notes.
WORD, IPA, GLOSS, CONTEXT, USE, SENTENCE_OF = "单词|^word", "音标|ipa", "释义|核心中文|gloss", "语境|context", "商务|日常|^use", "例句|sentence|example|^use"
RECORD = {"ipa": (IPA,), "gloss": (GLOSS, CONTEXT, USE), "context": (CONTEXT,), "use": (USE, CONTEXT)}
COLUMNS = {"word": WORD, "ipa": IPA, "gloss": GLOSS, "context": CONTEXT, "use": USE}
PHRASE = {"gloss": (GLOSS,), "sentence": (SENTENCE_OF, "释义|gloss")}


def records(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Vocabulary records (word, ipa, gloss, context, use) from notes, given as documents or as their blocks, whatever their layout.

    They stand under a heading that names a vocabulary: as rows of a table with named
    columns in any order, or as items whose parts stand under them as labelled items; the
    word is the item's bold term or the value of its label.  The ipa loses its slashes; a part
    that is missing or a placeholder is null, a record without a word is none.
    """
    row = F.col("kind") == "row"
    named = F.when(F.col("label").rlike(f"(?i){WORD}|本身"), F.col("value")).otherwise(F.col("label"))
    its, line_ends = F.col("its_ipa"), "\n\r\x85\u2028\u2029"
    slashed = its.startswith("/") & its.endswith("/") & (its != "/") & (F.translate(its, line_ends, "") == its)
    ipa = F.coalesce(F.col("ipa"), F.when(slashed, F.substring(its, F.lit(2), F.length(its) - 2)).otherwise(its))
    found = md.parts(rows, [key], "vocabulary", RECORD, COLUMNS)
    found = found.select(key, F.when(row, F.col("its_word")).otherwise(named).alias("word"), ipa.alias("ipa"), *[F.col(f"its_{n}").alias(n) for n in ("gloss", "context", "use")])
    return found.where("word IS NOT NULL")


def phrase_records(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Phrase records (phrase, gloss, sentence) from the items under a heading that names phrases, in documents or their blocks; the gloss may stand behind the phrase in parentheses."""
    named = F.when(F.col("label").rlike("(?i)短语|^phrase|本身"), F.col("value")).otherwise(F.col("label"))
    items = md.parts(rows, [key], "phrases", PHRASE).select(key, named.alias("phrase"), F.coalesce("aside", "its_gloss").alias("gloss"), F.col("its_sentence").alias("sentence"))
    return items.where("phrase IS NOT NULL")


def entities(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terms and definitions under a heading that names entities, as items or plain lines, with the ``link`` that the document names as its source (null if none)."""
    source = lambda b: F.coalesce(b["label"].rlike("(?i)来源|source|^link") & md.link(b["content"]).isNotNull(), F.lit(False))
    term = lambda b: md.under("entities", b) & b["kind"].isin("item", "text") & b["label"].isNotNull() & ~source(b)
    link = md.link(F.get(F.filter("blocks", source), F.lit(0))["content"])
    terms = F.transform(F.filter("blocks", term), lambda b: F.struct(b["label"].alias("term"), b["value"].alias("definition")))
    docs = md.gathered(rows, [key]).select(key, F.inline(F.array(F.struct(link.alias("link"), terms.alias("terms")))))
    return docs.select(key, F.inline("terms"), "link")


def faithful(source: Column, annotated: Column) -> Column:
    """True where the annotated text without its annotations is the source, white space aside."""
    flat = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    return flat(markdown.without_annotations(annotated)) == flat(source)
