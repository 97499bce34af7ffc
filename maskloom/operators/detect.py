"""Detection: all recognizers in one scan, context, line wraps, external spans, gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.fold import _fold, collapsed
from maskloom.functions.spans import let, regex_spans, spans_in, unmarked
from maskloom.operators.recognizers import ALL, LONG_RUN, NAME_LABELS, Recognizer
from maskloom.operators.types import flag_of, tier_of

THRESHOLD, UPLIFT = 0.4, 0.35
#: Characters before and after a hit in which context words count.
BEFORE, AFTER = 60, 20
FOUND = "struct<start:int,end:int,value:string,entity_type:string,score:double,source:string>"


def context_near(text: Column, start: Column, end: Column, words: Iterable[str]) -> Column:
    """True if a context word stands near the hit, the hit itself left out. Case-insensitive."""
    before = F.substr(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE)))
    near = F.lower(F.concat(before, F.lit(" "), F.substr(text, end + 1, F.lit(AFTER))))
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(near, w))


def folded(text: Column) -> Column:
    """Lower-cased, every i alike: how the ``needs`` of recognizers are written."""
    return F.replace(F.replace(F.lower(text), F.lit("ı"), F.lit("i")), F.lit("\u0307"), F.lit(""))


def _hits(text: Column, low: Column, run: Column, r: Recognizer) -> Column:
    hits = spans_in(text, r.regex)
    if r.trim:
        inner = lambda h: F.regexp_extract(h["value"], r.trim, 1)
        hits = F.transform(hits, lambda h: F.struct((h["end"] - F.char_length(inner(h))).alias("start"), h["end"].alias("end"), inner(h).alias("value")))

    def scored(h: Column) -> Column:
        score = F.lit(r.score)
        if r.context:
            score = F.least(F.lit(1.0), F.when(context_near(text, h["start"], h["end"], r.context), r.score + UPLIFT).otherwise(r.score))
        if r.valid is not None:
            score = F.when(r.valid(h["value"]), 1.0).otherwise(0.0)
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value"), F.lit(r.entity_type).alias("entity_type"), score.cast("double").alias("score"), F.lit(r.source).alias("source"))

    found = F.transform(hits, scored)
    if not r.needs and not r.long_run:
        return found
    may = F.lit(not r.needs)
    for w in r.needs:
        may = may | F.contains(low, F.lit(w))
    if r.long_run:
        may = run & may
    return F.when(may, found).otherwise(F.array().cast(f"array<{FOUND}>"))


def found_in(text: Column, recognizers: Iterable[Recognizer] = ALL, threshold: float = THRESHOLD) -> Column:
    """array of spans that reach the threshold, of all recognizers, from one reading of the text; null for null."""
    recognizers = tuple(recognizers)
    every = lambda t: let(folded(t), lambda low: let(t.rlike(LONG_RUN), lambda run: F.concat(*[_hits(t, low, run, r) for r in recognizers])))
    hits = F.when(text.isNotNull(), let(unmarked(text), every))
    return F.filter(hits, lambda h: h["score"] >= threshold)


def detect(units: DataFrame, recognizers: Iterable[Recognizer] = ALL, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each span: keys, start, end, value, entity_type, score, source. A scan, no shuffle."""
    spans = units.select(*keys, F.explode(found_in(F.col(text_col), tuple(recognizers), threshold)).alias("s"))
    return spans.select(*keys, "s.*")


def line_wrapped(units: DataFrame, recognizers: Iterable[Recognizer] = ALL, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Spans that a line end cuts in two.

    Line ends are deleted, the text is scanned again, and an offset is mapped back by the line ends
    that were before it. Only
    adjacency-safe types count, only if the original segment holds a line end, and none right after
    one of ``. ! ? : ; ,``.
    """
    text = F.col(text_col)
    breaks = F.transform(regex_spans(text, "\n"), lambda h, i: h["start"] - i)  # in the text without line ends
    joined = units.where(F.contains(text, F.lit("\n"))).withColumn("__at", breaks).withColumn("__flat", F.replace(text, F.lit("\n"), F.lit("")))
    spans = joined.select(*keys, text_col, "__at", F.explode(found_in(F.col("__flat"), tuple(recognizers))).alias("s")).where(flag_of(F.col("s.entity_type"), "adjacency_safe"))
    back = lambda at: at + F.size(F.filter("__at", lambda b: b <= at))
    start, end = back(F.col("s.start")), back(F.col("s.end") - 1) + 1
    out = spans.select(*keys, text_col, start.alias("start"), end.alias("end"), "s.entity_type", "s.score").withColumn("value", F.substr(text, F.col("start") + 1, F.col("end") - F.col("start")))
    out = out.where(F.contains("value", F.lit("\n")) & ~F.col("value").rlike(r"[.!?:;,]\n"))
    return out.select(*keys, "start", "end", "value", "entity_type", "score", F.lit("linewrap").alias("source"))


#: Labels of statistical detectors and the type they become; confidence is scaled.
NER_LABELS = {"PER": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION", "FAC": "LOCATION", "MISC": "NRP", "NORP": "NRP", "ORG": "ORGANIZATION"}
NER_SCALE = {"ORGANIZATION": 0.4, "NRP": 0.4}


def adopt_ner(spans: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of an external detector (label, score) with our types; unknown labels are left as they are.

    Without a column ``source`` they get ``ner``, which is what the gates look at.
    """
    labels = F.create_map(*[F.lit(x) for kv in NER_LABELS.items() for x in kv])
    scale = F.create_map(*[F.lit(x) for kv in NER_SCALE.items() for x in kv])
    out = spans.where("label <> 'DATE'").withColumn("entity_type", F.coalesce(F.try_element_at(labels, "label"), "label"))
    out = out.withColumn("score", F.col("score") * F.coalesce(F.try_element_at(scale, "entity_type"), F.lit(1.0)))
    if "source" not in out.columns:
        out = out.withColumn("source", F.lit("ner"))
    return out.where(F.col("score") >= threshold).drop("label")


#: Sources of statistical detectors; their guesses are gated, other sources' are not.
NER_SOURCES = ("en", "tr", "ner")
#: Nouns that name documents, not people: bare, possessive and plural, then the English ones.
DOCUMENT_NOUNS_TR = (
    ("sözleşme", "sözleşmesi", "sözleşmeler"), ("protokol", "protokolü", "protokoller"), ("rapor", "raporu", "raporlar"), ("fatura", "faturası", "faturalar"),
    ("teklif", "teklifi", "teklifler"), ("tutanak", "tutanağı", "tutanaklar"), ("şartname", "şartnamesi", "şartnameler"), ("dilekçe", "dilekçesi", "dilekçeler"),
    ("yönetmelik", "yönetmeliği", "yönetmelikler"), ("yönerge", "yönergesi", "yönergeler"), ("genelge", "genelgesi", "genelgeler"), ("karar", "kararı", "kararlar"),
    ("ek", "eki", "ekler"), ("beyanname", "beyannamesi", "beyannameler"), ("makbuz", "makbuzu", "makbuzlar"), ("irsaliye", "irsaliyesi", "irsaliyeler"),
    ("taahhütname", "taahhütnamesi", "taahhütnameler"), ("vekaletname", "vekaletnamesi", "vekaletnameler"), ("vekâletname", "vekâletnamesi", "vekâletnameler"),
    ("ihtarname", "ihtarnamesi", "ihtarnameler"), ("belge", "belgesi", "belgeler"), ("mutabakat", "mutabakatı", "mutabakatlar"), ("talimat", "talimatı", "talimatlar"),
)
DOCUMENT_NOUNS_EN = (
    "agreement", "agreements", "contract", "contracts", "report", "reports", "invoice", "invoices", "memorandum", "minutes", "proposal", "proposals",
    "certificate", "certificates", "protocol", "protocols", "receipt", "receipts", "regulation", "regulations", "addendum", "annex", "appendix", "amendment",
    "amendments",
)
#: Captions of forms beside those of name fields.
FORM_LABELS = (
    "Adres", "Adresi", "Adres Tipi", "Adres Türü", "Adres No", "Yerleşim Yeri", "Yerleşim Yeri Adresi", "İkamet Adresi", "Tebligat Adresi", "Diğer Adres",
    "Doğum Yeri", "Doğum Tarihi", "Kimlik No", "T.C. Kimlik No", "Kimlik Bilgileri", "Uyruğu", "Cinsiyeti", "Medeni Hali", "Telefon", "E-posta", "İl", "İlçe",
    "Mahalle", "Belge No", "Tarih",
)
#: Plural possessives follow the last vowel.
_NOUNS = {_fold(w) for forms in DOCUMENT_NOUNS_TR for w in (*forms, forms[2] + {"lar": "ı", "ler": "i"}[forms[2][-3:]])} | {_fold(w) for w in DOCUMENT_NOUNS_EN}
_CAPTIONS = {_fold(w) for w in (*NAME_LABELS, *FORM_LABELS)}
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def _words(value: Column) -> Column:
    return F.filter(F.split(value, _SPACE), lambda w: w != "")


def lowercase_initial(value: Column) -> Column:
    """G1: white space aside, it begins with a lower-case letter."""
    return value.rlike(rf"^(?:{_SPACE})?\p{{Ll}}")


def contains_document_noun(value: Column) -> Column:
    """G3: a word, edge punctuation and apostrophe suffix aside, is a document noun."""
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"^[,;:()\[\]\"'’.!?«»“”]+|[,;:()\[\]\"'’.!?«»“”]+$", ""), r"['’].*$", "")
    return F.arrays_overlap(F.transform(_words(value), lambda w: folded(bare(w))), F.array(*[F.lit(f) for f in sorted(_NOUNS)]))


def implausible_person(value: Column) -> Column:
    """G2: three words or more across a line end, a single word, a document noun, or a longer word that begins in lower case."""
    words = _words(value)
    return ((F.size(words) >= 3) & F.contains(value, F.lit("\n"))) | (F.size(words) == 1) | contains_document_noun(value) | F.exists(words, lambda w: (F.char_length(w) >= 3) & w.rlike(r"^\p{Ll}"))


def date_shaped(value: Column) -> Column:
    """G4: the whole value reads day, month, year."""
    return F.trim(value).rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$")


def form_label(value: Column) -> Column:
    """G5: the value is a form caption, case and white space aside."""
    return folded(collapsed(value)).isin(sorted(_CAPTIONS))


def caps_line(text: Column, start: Column, end: Column) -> Column:
    """G6: the line around the span has four words of letters or more, four fifths of them in capitals.

    A word counts if it has letters only, edge punctuation aside: addresses, dates and codes say nothing.
    """
    before = F.element_at(F.split(F.substr(text, F.lit(1), start), "\n"), -1)
    after = F.element_at(F.split(F.substr(text, start + 1, F.char_length(text)), "\n"), 1)
    bare = F.transform(F.split(F.concat(before, after), r"[ \t\x0B\f\r]+"), lambda w: F.regexp_replace(w, r"^[,;:()\"'’]+|[,;:()\"'’]+$", ""))
    words = F.filter(bare, lambda w: w.rlike(r"^\p{L}+$"))
    caps = F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    return (F.size(words) >= 4) & (caps * 5 >= F.size(words) * 4)


def gated(spans: DataFrame, text_col: str = "text") -> DataFrame:
    """Spans that pass all gates. Needs value, entity_type, start, end, source and the unit's text.

    G2, G5 and G6 look at guesses of statistical detectors only (``NER_SOURCES``), G1 at the types they
    guess, G4 at phone numbers of any source. Gates come before resolution.
    """
    kind, value = F.col("entity_type"), F.col("value")
    ner, guess = flag_of(kind, "ortho_gated"), F.coalesce(F.col("source"), F.lit("")).isin(*NER_SOURCES)
    drop = (
        (ner & lowercase_initial(value))
        | (guess & (kind == "PERSON") & implausible_person(value))
        | (kind.isin("PHONE_NUMBER", "TR_PHONE", "TR_GSM", "UK_PHONE") & date_shaped(value))
        | (guess & ner & form_label(value))
        | (guess & ner & caps_line(F.col(text_col), F.col("start"), F.col("end")))
    )
    return spans.where(~drop)


def prioritised(spans: Column) -> Column:
    """Spans with the sort key of resolution in front: tier, higher score, longer, earlier, type."""
    return F.transform(
        spans,
        lambda s: F.struct(
            tier_of(s["entity_type"]).alias("tier"),
            (-s["score"]).alias("rank"),
            (s["start"] - s["end"]).alias("size"),
            s["start"].alias("start"),
            s["entity_type"].alias("entity_type"),
            s["end"].alias("end"),
            s["source"].alias("source"),
            s["score"].alias("score"),
        ),
    )
