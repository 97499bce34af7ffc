"""Retrieval over masked text: chunks, BM25, excerpts, citations, chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.fold import ascii_tokens
from maskloom.functions.spans import let

CHUNK, EXCERPT, TURNS, TURN_CHARS = 1200, 400, 8, 4000
K1, B = 1.5, 0.75
#: Ends of lines, white space, and a place inside a placeholder.
_LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
_BLANK = r"[\s\p{Z}\x1C-\x1F\x85]"
_IN_HOLDER = r"(?<=<[A-Z_]{0,60}[0-9]{0,12})[A-Z_]*[0-9]*>"


def line_pieces(line: Column, size: int = CHUNK) -> Column:
    """An over-long line as pieces of at most ``size`` characters, by one regular expression.

    A piece is the rest of the line if it fits; else it ends before the last space that leaves it at
    least half the size; else it is as long as can be without an end inside a placeholder. White space
    around cuts goes.
    """
    piece = rf"(?s)(?:\A|{_BLANK}*+)(.{{1,{size}}}\z|.{{{size // 2},{size}}}(?= )|.{{1,{size}}}(?!{_IN_HOLDER}))"
    parts = F.regexp_extract_all(line, F.lit(piece), F.lit(1))
    rest = lambda x, i, p: (i == F.size(p) - 1) & F.endswith(line, x)
    cut = let(parts, lambda p: F.transform(p, lambda x, i: F.when(rest(x, i, p), x).otherwise(F.regexp_replace(x, f"{_BLANK}+$", ""))))
    return F.filter(cut, lambda x: x.rlike(f"^{_BLANK}*$") == F.lit(False))


def chunked(text: Column, size: int = CHUNK) -> Column:
    """array of chunks: lines that are not blank, packed in order while they fit; over-long lines in pieces."""
    lines = F.filter(F.split(text, _LINE_END), lambda x: ~x.rlike(f"^{_BLANK}*$"))
    pieces = F.flatten(F.transform(lines, lambda x: F.when(F.char_length(x) <= size, F.array(x)).otherwise(line_pieces(x, size))))

    def pack(acc: Column, x: Column) -> Column:
        fits = F.char_length(acc["open"]) + 1 + F.char_length(x) <= size
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), x).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), x.alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(pieces, start, pack, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def chunk_texts(docs: DataFrame, size: int = CHUNK, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, part from 1, text) of every chunk; JVM expressions of one scan."""
    rows = docs.select(doc, F.posexplode(chunked(F.col(text_col), size)).alias("part", "text"))
    return rows.withColumn("part", F.col("part") + 1)


def bm25(chunks: DataFrame, query: str, k: int | None = 8, tokens=ascii_tokens, order: tuple[str, ...] = ("doc_id", "part"), text_col: str = "text") -> DataFrame:
    """Chunks with their BM25 score for the query, the k best (all, if k is null); score 0 ranks too.

    Document frequency, number and mean length of chunks come from one aggregation over all chunks; a
    query term counts as often as the query has it. Ties go by ``order``. Only the query's terms are
    counted in a chunk, so nothing is exploded and the ranking is a top-k without a full sort.
    """
    words = chunks.sparkSession.createDataFrame([(query,)], "q string").select(tokens(F.col("q")).alias("w")).first()["w"]
    terms = sorted(set(words))
    toks = chunks.withColumn("__t", tokens(F.col(text_col))).withColumn("__n", F.size("__t"))
    times = lambda t: F.size(F.filter("__t", lambda x: x == F.lit(t)))
    tf = [times(t).alias(f"__tf{i}") for i, t in enumerate(terms)]
    counted = toks.select(*order, text_col, "__n", *tf)
    stats = counted.agg(F.count("*").alias("N"), F.avg("__n").alias("avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        df, f = F.col(f"df{i}"), F.col(f"__tf{i}")
        idf = F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5))
        score = score + words.count(t) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__n") / F.col("avg")))
    out = joined.select(*order, text_col, F.round(score, 9).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), *order).limit(k)


def sourced(ranked: DataFrame, order: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """Ranked chunks (a top-k) with ids S1, S2, ... by rank."""
    n = F.row_number().over(Window.orderBy(F.desc("score"), *order))
    return ranked.withColumn("id", F.concat(F.lit("S"), n))


def excerpt(text: Column, size: int = EXCERPT) -> Column:
    """At most ``size`` characters and an ellipsis; a placeholder that would be cut is left out."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.rtrim(F.regexp_replace(F.substring(flat, 1, size), r"<[A-Z_]*[0-9]*$", ""))
    return F.when(F.char_length(flat) <= size, flat).otherwise(F.concat(head, F.lit("…")))


def normal_citations(text: Column) -> Column:
    """``[S1, S2]`` becomes ``[S1][S2]``."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=\[S[0-9]{1,4}|, S[0-9]{1,4}),\s*(?=S[0-9])", ", "), r"(S[0-9]+), (?=S[0-9])", "$1][")


def citations(text: Column) -> Column:
    """Distinct cited ids in order."""
    return F.array_distinct(F.regexp_extract_all(normal_citations(text), F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def citations_valid(text: Column, known: Column) -> Column:
    """At least one citation, and every one known."""
    return (F.size(citations(text)) > 0) & (F.size(F.array_except(citations(text), known)) == 0)


def recent_turns(conversations: DataFrame, n: int = TURNS, most: int = TURN_CHARS) -> DataFrame:
    """The last n turns of each conversation, redacted, then cut to ``most`` characters."""
    from maskloom.operators.audit import mini_redacted

    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return conversations.withColumn("back", back).where(F.col("back") <= n).select("conv_id", "turn", "role", F.substring(mini_redacted(F.col("text")), 1, most).alias("text"))


def consent_hash(payload: Column) -> Column:
    """sha256 of the canonical JSON of what would be sent."""
    return F.sha2(F.to_json(payload), 256)
