import unicodedata

import pytest
from pyspark.sql import functions as F

from orrery.functions import text as fn

CASES = {
    "Ａ Ｂ　c": "abc", "™": "TM", "№": "No", "㎏": "kg", "x\u0085y": "xy", "a\u001cb": "a\u001cb", "ΣΑΣ": "σας", "İ": "i̇", "é": "é",
    chr(0xF900): chr(0x8C48) + chr(0xFE00), chr(0xFB00): "ff", chr(0xBD): "1" + chr(0x2044) + "2", "a b" + chr(9) + "c" + chr(0xA0) + "d": "abcd", "": "",
}


@pytest.mark.parametrize("raw", CASES)
def test_goldens(raw):
    assert fn.normalize_text(raw) == CASES[raw]


def test_column_agrees_with_function(spark):
    rows = [(s,) for s in [*CASES, None, "Straße", "ÀÉÎ õ", "日本 語", "Ünï cödé", "a…b", "naïve x"]]
    got = spark.createDataFrame(rows, "s string").select("s", fn.normalized(F.col("s")).alias("n")).collect()
    assert [r.n for r in got] == [fn.normalize_text(r.s) for r in got]


def test_ascii_is_done_natively(spark):
    ascii_ = "".join(map(chr, range(1, 128)))
    got = spark.createDataFrame([(ascii_,)], "s string").select(fn.normalized(F.col("s"))).first()[0]
    assert got == fn.normalize_text(ascii_) and "\x1c" in got and unicodedata.normalize("NFKC", got) == got


def test_variant_search_is_one_way():
    plain, form = chr(0x8C48), chr(0xF900)
    assert fn.normalize_text(plain) in fn.normalize_text(form)
    assert fn.normalize_text(form) not in fn.normalize_text(plain)
    table = fn.compatibility_variants()
    assert len(set(table.values())) == len(table) > 900
    assert table[0x2F901] == chr(0x6D77) + chr(0xFE01) and table[0xFA45] == chr(0x6D77) + chr(0xFE00)


def test_small_functions(spark):
    df = spark.createDataFrame([("　 Ann\t", "https://x/y/a.b.jpg", 2.5)], "name string, url string, r double")
    got = df.select(fn.trim_white(F.col("name")), fn.file_name(F.col("url")), fn.upscaled_name(fn.file_name(F.col("url")), 2), fn.ratio_bucket(F.col("r")), fn.display_rating(F.lit(5), F.lit(1))).first()
    assert tuple(got) == ("Ann", "a.b.jpg", "a_b_jpg_2x.png", 3, 3)
    fn.register(spark)
    assert spark.sql("SELECT normalized('™ A')").first()[0] == "TMa"
