"""Keyboard layouts: key tables typed in from public standards, and conversion between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of 13, 13, 11 and 10 keys, without and with shift. US QWERTY, ЙЦУКЕН, a Russian phonetic layout, SI-1452 and a Hebrew phonetic one.
KEYS = {
    "us": (r"`1234567890-=qwertyuiop[]\asdfghjkl;'zxcvbnm,./", r'~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?'),
    "ru": (r"ё1234567890-=йцукенгшщзхъ\фывапролджэячсмитьбю.", r'Ё!"№;%:?*()_+ЙЦУКЕНГШЩЗХЪ/ФЫВАПРОЛДЖЭЯЧСМИТЬБЮ,'),
    "ru_phonetic": (r"ю1234567890-ьявертыуиопшщэасдфгчйкл;'зхцжбнм,./", r'Ю!@#$%^&*()_ЬЯВЕРТЫУИОПШЩЭАСДФГЧЙКЛ:"ЗХЦЖБНМ<>?'),
    "he": (r";1234567890-=/'קראטוןםפ][\שדגכעיחלךף,זסבהנמצתץ.", r'~!@#$%^&*)(_+QWERTYUIOP}{|ASDFGHJKL:"ZXCVBNM><?'),
    "he_qwerty": (r"`1234567890-=קוערתטואיפ[]\אסדפגהיכל;'זחצבבנמ,./", r'~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?'),
}
#: Layout, language, prior (higher is more likely installed).
LAYOUTS = (("us", "en", 300), ("ru", "ru", 300), ("ru_phonetic", "ru", 200), ("he", "he", 300), ("he_qwerty", "he", 150))
#: Characters that conversion leaves alone.
PRESERVED = "«»„“”‘’—–…№©®™°€£¥₽₴₪!?-_(){}/\\@#$%^&*+=<>|~`0123456789"
MODIFIERS = ("n", "s")


def keymap(spark: SparkSession, layouts=tuple(KEYS)) -> DataFrame:
    """(layout_id, key, modifier, ch) of the built-in layouts; keys are numbered by row."""
    rows = [(layout, f"k{at:02d}", modifier, ch) for layout in layouts for modifier, chars in zip(MODIFIERS, KEYS[layout], strict=True) for at, ch in enumerate(chars)]
    return spark.createDataFrame(rows, "layout_id string, key string, modifier string, ch string")


def compose_charmap(keys: DataFrame, src: str, dst: str) -> DataFrame:
    """(src_ch, dst_ch): characters on the same key and level; the lowest level wins, then the key's name."""
    rank = F.element_at(F.create_map(*(x for n, m in enumerate(("n", "s", "a", "sa")) for x in (F.lit(m), F.lit(n)))), F.col("modifier"))
    one = keys.where(F.col("layout_id") == src).select("key", "modifier", F.col("ch").alias("src_ch"))
    two = keys.where(F.col("layout_id") == dst).select("key", "modifier", F.col("ch").alias("dst_ch"))
    best = Window.partitionBy("src_ch").orderBy(rank, "key")
    return one.join(two, ["key", "modifier"]).withColumn("at", F.row_number().over(best)).where("at = 1").select("src_ch", "dst_ch")


def pair(src: str, dst: str) -> tuple[str, str]:
    """The same map for built-in layouts as a pair of strings for ``translate``, preserved characters left out."""
    made: dict[str, str] = {}
    for a_row, b_row in zip(KEYS[src], KEYS[dst], strict=True):
        for a, b in zip(a_row, b_row, strict=True):
            made.setdefault(a, b)
    kept = {a: b for a, b in made.items() if a not in PRESERVED and a != b}
    return "".join(kept), "".join(kept.values())


def convert(text: Column, src: str, dst: str) -> Column:
    """The text as the same keys give it on another layout."""
    return F.translate(text, *pair(src, dst))
