"""Term lists: where terms occur, what is denied, what is kept."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.fold import literal_pattern, term_key
from maskloom.functions.spans import regex_spans


#: Terms of ordinary business that are never personal, by field: companies, law, finance, staff, public bodies.
BUSINESS_TERMS = {
    "company": (
        "Genel Kurul", "Yönetim Kurulu", "Denetim Kurulu", "Faaliyet Raporu", "Olağan Genel Kurul", "Olağanüstü Genel Kurul", "Yönetim Kurulu Kararı", "İcra Kurulu",
        "Murahhas Üye", "Bağımsız Üye", "Bağımsız Denetim", "Kurumsal Yönetim İlkeleri", "Esas Sözleşme", "Ticaret Sicili", "Ticaret Sicil Gazetesi", "Sermaye Piyasası Kurulu",
        "Kamuyu Aydınlatma Platformu", "Pay Sahipleri",
    ),
    "law": (
        "Sözleşme Bedeli", "Teslim Tarihi", "Ödeme Planı", "Cayma Hakkı", "Fesih Bildirimi", "Mücbir Sebep", "Gizlilik Sözleşmesi", "Rekabet Yasağı", "Uyuşmazlık Çözümü",
        "Yetkili Mahkeme", "Tahkim Şartı", "Temerrüt Faizi", "Kesin Teminat", "Geçici Teminat", "İhtarname", "Protokol", "Ek Protokol", "Taraflar Arasında", "İşbu Sözleşme",
        "Hizmet Sözleşmesi", "Kira Sözleşmesi", "Satış Sözleşmesi", "İş Sözleşmesi",
    ),
    "finance": (
        "Fatura Dönemi", "Gider Pusulası", "Vergi Matrahı", "Katma Değer Vergisi", "Gelir Vergisi", "Kurumlar Vergisi", "Stopaj", "Amortisman", "Bilanço", "Gelir Tablosu",
        "Nakit Akış Tablosu", "Bağımsız Denetim Raporu", "Mizan", "Cari Hesap Ekstresi", "Hesap Özeti", "Ödeme Bildirimi", "Tahsilat Makbuzu", "Kredi Notu",
        "Risk Değerlendirmesi", "Teminat Mektubu",
    ),
    "staff": (
        "İş Sağlığı ve Güvenliği", "Yıllık İzin", "Kıdem Tazminatı", "İhbar Tazminatı", "Performans Değerlendirmesi", "Disiplin Yönetmeliği", "Özlük Dosyası",
        "İş Sözleşmesi Feshi", "Deneme Süresi", "Fazla Mesai", "Sosyal Güvenlik Kurumu", "Bordro", "Ücret Bordrosu", "Kalite Kontrol", "Kalite Yönetim Sistemi",
    ),
    "public": (
        "Başvuru Dilekçesi", "İlgili Makam", "Yetkili Kurum", "Resmi Gazete", "Kamu İhale Kurumu", "Valilik", "Kaymakamlık", "Belediye Meclisi", "İmar Planı",
        "Ruhsat Başvurusu", "Bilgi Edinme Başvurusu",
    ),
}


def business_terms(spark: SparkSession) -> DataFrame:
    """The built-in allow-list as (ord, term, family), to stand first in ``effective_terms``."""
    rows = [(i, t, None) for i, t in enumerate(t for terms in BUSINESS_TERMS.values() for t in terms)]
    return spark.createDataFrame(rows, "ord int, term string, family string")


def term_ranges(text: Column, terms: Iterable[str], suffix: str = "") -> Column:
    """array<struct<start, end, value>> of all terms: case-insensitive, any run of white space between words."""
    arrays = [regex_spans(text, literal_pattern(t) + suffix) for t in dict.fromkeys(terms) if t.split()]
    return F.concat(*arrays) if arrays else F.array().cast("array<struct<start:int,end:int,value:string>>")


def keep_ranges(text: Column, terms: Iterable[str]) -> Column:
    """Term ranges that run on over an apostrophe and the letters after it."""
    return term_ranges(text, terms, r"(?:['’]\p{L}+)?")


def _typed(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value"), F.lit(kind).alias("entity_type")))


def deny_spans(units: DataFrame, terms: dict[str, str | None], keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """A span for each hit of a denied term: type ``USER:<family>``, or SENSITIVE without one; score 1."""
    arrays = []
    for term, family in terms.items():
        kind = f"USER:{family}" if family else "SENSITIVE"
        arrays.append(_typed(term_ranges(F.col(text_col), [term]), kind))
    if not arrays:
        return units.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"), F.lit("").alias("entity_type"), F.lit(1.0).alias("score"), F.lit("deny").alias("source")).limit(0)
    out = units.select(*keys, F.explode(F.concat(*arrays)).alias("s")).select(*keys, "s.*")
    return out.select(*keys, "start", "end", "value", "entity_type", F.lit(1.0).alias("score"), F.lit("deny").alias("source"))


def trimmed_edges(value: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds of the span without white space at its edges."""
    return (
        start + F.char_length(value) - F.char_length(F.regexp_replace(value, r"^\s+", "")),
        end - F.char_length(value) + F.char_length(F.regexp_replace(value, r"\s+$", "")),
    )


def not_contained(spans: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans that lie in no range of the same unit: an anti join on the unit keys and containment."""
    start, end = trimmed_edges(F.col("s.value"), F.col("s.start"), F.col("s.end"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = (F.col("r.start") <= start) & (end <= F.col("r.end"))
    for c in same:
        on = on & c
    return spans.alias("s").join(ranges.alias("r"), on, "left_anti")


def effective_terms(*lists: DataFrame, enabled: bool = True) -> DataFrame:
    """Union of (term, family) lists in order, the first spelling of each key; nothing if switched off."""
    first, *rest = [t.withColumn("list", F.lit(i)) for i, t in enumerate(lists)]
    for t in rest:
        first = first.unionByName(t)
    keyed = first.withColumn("key", term_key(F.col("term"))).where("key <> ''")
    out = keyed.groupBy("key").agg(F.min_by(F.struct("term", "family"), F.struct("list", "ord")).alias("t"), F.min(F.struct("list", "ord")).alias("at"))
    out = out.select("key", "t.*", "at")
    return out.where(F.lit(enabled))


def allow_minus_deny(allow: DataFrame, deny: DataFrame, document_keep: DataFrame) -> DataFrame:
    """Allowed keys that are not denied, and the document's own keeps, which beat both."""
    left = allow.select("key").join(deny.select("key"), "key", "left_anti")
    return left.union(document_keep.select("key")).distinct()
