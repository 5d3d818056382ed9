"""Column functions for titles and wikitext."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the data's conventions for right results.
NAMESPACES = ("Special", "特別", "Talk", "ノート", "User", "利用者", "Wikipedia", "File", "Image", "ファイル", "MediaWiki", "メディアウィキ", "Template", "テンプレート", "Help", "ヘルプ", "Category", "カテゴリ", "Portal", "ポータル", "Draft", "下書き", "Module", "モジュール", "Book", "TimedText", "Gadget", "Gadget definition", "Media", "メディア")
TALK = ("‐トーク", "-トーク", "_トーク", "‐Talk", "-Talk", "_Talk", " talk")
INTERWIKI = ("en", "de", "fr", "es", "it", "pt", "ru", "zh", "ko", "simple", "commons", "wiktionary", "wikiquote", "ja")
HUB_CLASSES = {
    "disambig": r"\(曖昧さ回避\)|曖昧さ回避$",
    "list": r"一覧$|一覧_|^リスト|の一覧",
    "year": r"^\p{Nd}{1,4}年$|^\p{Nd}{1,4}年の|^\p{Nd}{4}年度",
    "date": r"^\p{Nd}{1,2}月\p{Nd}{1,2}日$",
    "jp_geo": r"^日本の|^日本における",
    "index": r"^索引|^Wikipedia:|^Category:",
}
NAME_BLACKLIST = (r"を使用しているページ", r"^ウィキデータにある", r"^ウィキデータにない", r"誤りがあるページ", r"仮リンク", r"保護中のページ", r"翻訳を必要とする", r"にbackgroundと", r"^すべての", r"曖昧さ回避$", r"不明$", r"名目録$", r"^Template", r"^Pages ", r"^Articles ", r"^Use dmy")
STEMS = (r"^(.+?)(?:に関する|関連の|関連)?スタブ(?:項目|記事)?$", r"^(.+?)に関する記事(?:の一覧)?$", r"^(.+?)の一覧$")
MEDIUM_PATTERNS = (r"^\p{Nd}{1,4}年", r"^(昭和|平成|大正|明治|慶応|江戸時代|19世紀|20世紀|21世紀)$")
MEDIUM_HUBS = ("日本", "英語", "ISBN", "地理座標系", "ウェイバックマシン", "YouTube", "X_(ソーシャル・ネットワーキング・サービス)", "デジタルオブジェクト識別子", "ISSN", "PubMed", "国立国会図書館", "アメリカ合衆国", "日本の郵便番号", "NDL", "VIAF", "LCCN", "CiNii", "GND")

PREFIXES = sorted({*NAMESPACES, *(n + t for n in NAMESPACES for t in TALK), *INTERWIKI})
LINK = r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"


def normalize_title(t: Column) -> Column:
    """Link target as a page title: no anchor, underscores for spaces, first ASCII letter upper case; null if empty."""
    s = F.btrim(F.split_part(t, F.lit("#"), F.lit(1)), F.lit(" \t\n\x0b\x0c\r"))
    s = F.regexp_replace(s, "^:+", "")
    s = F.btrim(F.regexp_replace(F.replace(s, F.lit(" "), F.lit("_")), "_+", "_"), F.lit("_"))
    up = F.concat(F.upper(F.left(s, F.lit(1))), F.right(s, F.char_length(s) - 1))
    return F.nullif(F.when(s.rlike("^[a-z]"), up).otherwise(s), F.lit(""))


def has_skipped_prefix(t: Column) -> Column:
    """Whether a title begins with a namespace or interwiki prefix."""
    head = F.split_part(t, F.lit(":"), F.lit(1))
    lower = [p.lower() for p in PREFIXES if p.isascii()]
    ascii_only = F.octet_length(head) == F.char_length(head)
    return t.contains(":") & (head.isin(PREFIXES) | (ascii_only & F.lower(head).isin(lower)))


def clean_wikitext(t: Column, strip_refs: bool = False) -> Column:
    patterns = [r"<nowiki\s*/>|<nowiki\b[^>]*>.*?</nowiki>", r"<!--.*?-->", r"<includeonly\b[^>]*>.*?</includeonly>"] + [r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>"] * strip_refs
    return reduce(lambda c, p: F.regexp_replace(c, f"(?s){p}", ""), patterns, t)


def wikilinks(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(LINK), F.lit(1))


def hub_flags(title: Column) -> Column:
    """Array of the hub classes a title belongs to."""
    return F.filter(F.array(*[F.when(title.rlike(p), F.lit(k)) for k, p in HUB_CLASSES.items()]), lambda x: x.isNotNull())


def blacklisted(title: Column) -> Column:
    return title.rlike("|".join(f"(?:{p})" for p in NAME_BLACKLIST))


def name_stem(title: Column) -> Column:
    """Subject of a maintenance category's title, empty if there is none worth having."""
    found = []
    for p in STEMS:
        stem = F.regexp_replace(F.regexp_extract(title, p, 1), "[の_ ・]+$", "")
        found.append(F.when(title.rlike(p) & (F.char_length(stem) >= 2) & ~blacklisted(stem), stem))
    return F.when(title.isNull() | blacklisted(title), "").otherwise(F.coalesce(*found, F.lit("")))


def sql_unescape(s: Column) -> Column:
    """Undoes backslash escapes of SQL dumps; an unknown escape is the character itself.

    The text is cut at doubled backslashes, so that none of them begins another escape.
    """
    known = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}

    def part(p: Column) -> Column:
        for k, v in known.items():
            p = F.replace(p, F.lit("\\" + k), F.lit(v))
        return F.regexp_replace(p, r"\\(.)", "$1")

    return F.when(F.instr(s, "\\") == 0, s).otherwise(F.array_join(F.transform(F.split(s, r"\\\\", -1), part), "\\"))


def name_choice(name: Column, share: Column, top3: Column, reps: Column, least: float = 0.15) -> Column:
    """struct(name, source): the first of the tf-idf name and the most common categories (array of title, share) that has the
    least share and is no maintenance name, or the subject in it; else the first representative title."""
    first = F.array(F.struct(name.alias("title"), F.coalesce(share, F.lit(0.0)).cast("double").alias("share")))
    rest = F.coalesce(F.transform(top3, lambda x: F.struct(x["title"].alias("title"), x["share"].cast("double").alias("share"))), F.slice(first, 1, 0))
    fine = F.filter(F.concat(first, rest), lambda x: x["title"].isNotNull() & (x["title"] != "") & (x["share"] >= least) & ~blacklisted(x["title"]))
    title = F.get(fine, F.lit(0))["title"]
    stem, rep = F.coalesce(name_stem(title), F.lit("")), F.get(reps, F.lit(0))
    pick = lambda n, s: F.struct(n.cast("string").alias("name"), F.lit(s).alias("source"))
    return (
        F.when(title.isNotNull() & (stem != ""), pick(stem, "category_stem"))
        .when(title.isNotNull(), pick(title, "category"))
        .when(rep.isNotNull(), pick(F.concat(rep, F.when(F.size(reps) > 1, "等").otherwise("")), "rep"))
        .otherwise(pick(F.lit(""), "none"))
    )


def resolution_tag(resolution: float, suffix: str = "") -> str:
    """Name of what a resolution gives: res0.5, res1, res2_sub."""
    return f"res{resolution:g}{suffix}"


def display_class(n: Column, reps: Column, out_ratio: Column) -> Column:
    """dust, medium or galaxy, by size, representative titles and out ratio."""
    hubs = F.size(F.array_intersect(F.slice(reps, 1, 3), F.array(*map(F.lit, MEDIUM_HUBS))))
    first = F.get(reps, F.lit(0))
    dated = first.rlike("|".join(MEDIUM_PATTERNS)) | first.isin(list(MEDIUM_HUBS))
    return F.when(n <= 1, "dust").when(F.coalesce(dated, F.lit(False)) | (hubs >= 2) | ((n >= 1000) & (out_ratio >= 0.90)), "medium").otherwise("galaxy")
