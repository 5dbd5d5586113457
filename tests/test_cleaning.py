"""Golden cases of cleaning and fragment quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import cleaning as cl
from corpusloom.functions.lexical import nfkc
from corpusloom.operators.text import split_text


def clean(spark, text: str, **options) -> str:
    df = spark.createDataFrame([(text,)], "text string").withColumn("text", nfkc("text"))
    return cl.cleaned(df, **options).first()["text"]


def is_low(spark, text: str) -> bool:
    df = spark.createDataFrame([(text,)], "text string").select(cl.normalised(F.col("text")).alias("normal")).withColumn("lines", cl.lines_of(F.col("normal")))
    return df.select(cl.quality_columns("lines", "normal")["low"].alias("low")).first()["low"]


def test_normalises(spark):
    assert clean(spark, "ＡＩ​ 学习\x00\n\n") == "AI 学习"


def test_punctuation(spark):
    assert clean(spark, "这是中文, 句子! 还有问题? 结束.") == "这是中文，句子！还有问题？结束。"


def test_broken_lines(spark):
    got = clean(spark, "This is an exam-\nple sentence.\n下一行，\n继续。")
    assert "example sentence." in got and "下一行，继续。" in got


def test_latin_noise(spark):
    assert clean(spark, "bAo\nhM\nzhTng\n中文内容") == "中文内容"
    got = clean(spark, "人民教育出版社\ndaikocicn\nz.nyong\nPython\nAI\nDNA\nWiFi\n作用")
    assert "daikocicn" not in got and "z.nyong" not in got
    assert all(w in got for w in ("Python", "AI", "DNA", "WiFi", "作用"))


def test_structure_stays(spark):
    got = clean(spark, '# 标题\n\n```python\nprint("hello")\n```\n\n正文段落。', structure=True)
    assert 'print("hello")' in got and "正文段落" in got


def test_annotations(spark):
    got = clean(spark, "家jiQ\n中zhTng\n需xO\n要ySo\n一yK\n些xiE\n圆yuWn\n形xIng\n的de\n杯bEi\n垫diSn\n。我wG\n们men\n吗ma\n？", pdf=True)
    assert got == "家中需要一些圆形的杯垫。我们吗？"
    assert "家jiQ" in clean(spark, "我们学习拼音示例时提到家jiQ，但不应该触发全段清洗。", pdf=True)


def test_low_quality(spark):
    assert is_low(spark, "shRn\n么\n第四单元\n使")
    assert not is_low(spark, "A long and ordinary sentence about nothing in particular, which goes on.\nAnother one follows it here.")


def test_split_covers_the_text():
    text = " ".join(f"word{i}" for i in range(900))
    pieces = split_text(text)
    assert all(len(p) <= 1000 for p in pieces)
    assert set(" ".join(pieces).split()) >= set(text.split()) and pieces[0] + pieces[1][-1:] and text.startswith(pieces[0]) and text.endswith(pieces[-1])
    assert split_text("x" * 2500) and sum(map(len, split_text("x" * 2500))) >= 2500
