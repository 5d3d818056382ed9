from pyspark.sql import functions as F

from linkloom.functions import titles
from linkloom.sources import dumps


def values(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(expression(F.col("t"))).collect()]


def test_normalize(spark):
    got = values(spark, ["lower case", "A__B  C#sec", ":Category:X", "#anchor", "", None, "::", "é x"], titles.normalize_title)
    assert got == ["Lower_case", "A_B_C", "Category:X", None, None, None, None, "é_x"]


def test_prefix(spark):
    assert values(spark, ["File:A", "En:B", "Category talk:C", "A", "A:B", "カテゴリ:x"], titles.has_skipped_prefix) == [True, True, True, False, False, True]


def test_stem(spark):
    got = values(spark, ["シングル関連のスタブ項目", "野球に関する記事", "地理座標系の一覧", "すべてのスタブ", "Xの一覧", None], titles.name_stem)
    assert got == ["シングル", "野球", "地理座標系", "", "", ""]


def test_hub_flags(spark):
    assert values(spark, ["東京_(曖昧さ回避)", "日本の鉄道駅一覧", "2024年", "x"], titles.hub_flags) == [["disambig"], ["list", "jp_geo"], ["year"], []]


def test_clean_and_links(spark):
    text = "[[A|b]] <!-- [[C]] --><nowiki>[[D]]</nowiki><nowiki/>[[E#x]] <ref name=a>[[F]]</ref>"
    assert values(spark, [text], lambda t: titles.wikilinks(titles.clean_wikitext(t))) == [["A", "E#x", "F"]]
    assert values(spark, [text], lambda t: titles.wikilinks(titles.clean_wikitext(t, strip_refs=True))) == [["A", "E#x"]]


def test_unescape(spark):
    assert values(spark, [r"a\'b\\n\n\x"], titles.sql_unescape) == ["a'b\\n\nx"]


def test_category_dump(spark):
    line = r"INSERT INTO `categorylinks` VALUES (1000,'SORT\'KEY','2024-01-01 00:00:00','','page',5,77),(1001,'x','2024-01-01 00:00:00','p','subcat',5,78);"
    got = dumps.parse_tuples(spark.createDataFrame([(line,)], "value string"), "categorylinks").collect()
    assert [tuple(r) for r in got] == [(1000, "page", 77), (1001, "subcat", 78)]


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><text bytes="3">x [[B]]</text></revision></page><page><title>B</title><ns>0</ns><id>2</id><redirect title="A" /><revision><text bytes="1">y</text></revision></page></mediawiki>')
    got = dumps.read_pages_xml(spark, str(tmp_path / "a.xml")).orderBy("page_id").collect()
    assert [(r.page_id, r.is_redirect, r.text) for r in got] == [(1, False, "x [[B]]"), (2, True, "y")]
