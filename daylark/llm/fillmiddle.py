"""Fill-in-middle transformation by lookaround splitting.

A unit grammar is a boundary: the class of the character before it and that of the one after it. It is
translated to a zero-width regex of neighbouring classes, at which Spark's ``split`` cuts without taking
a character away, so that the pieces joined give the text. Two of a text's cuts, chosen by the hash of
seed and id, bound the middle. Everything is built of Spark's own functions.

Defined cases: a null text counts as empty; an empty text has no units and stays plain, as does one
that holds a marker. A null id counts as empty text in the hash. Repeated rows get the same result,
whole texts are cut whatever their length, an empty table gives an empty result. Columns other than
the keys and the text aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Grammar:
    """Units end where a character (or two) of ``before`` meets one of ``after``; either is a regex of fixed width."""

    before: str
    after: str = r"[\s\S]"

    @property
    def boundary(self) -> str:
        return f"(?<={self.before})(?={self.after})"


GRAMMARS = {
    "line": Grammar(r"\n"),
    "word": Grammar(rf"[{SPACE}]", rf"[^{SPACE}]"),
    "sentence": Grammar(rf"[.!?][{SPACE}]", rf"[^{SPACE}]"),
    "paragraph": Grammar(r"\n\n", r"[^\n]"),
}


def pieces(text: Column, unit: str = "line") -> Column:
    """The units of a text in order; none for an empty one (``split`` would give one empty piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, GRAMMARS[unit].boundary, -1))


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = SEED) -> DataFrame:
    """id, n units, form (plain, psm or spm), the three parts and the ``output`` text.

    ``percent`` of the texts are transformed, ``spm_percent`` of them with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), digest.alias("__hash"))
    rows = rows.select(id_col, "__text", pieces(F.col("__text"), unit).alias("__units"), *[
        F.conv(F.substring("__hash", 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)
    ])
    rows = rows.withColumn("n", F.size("__units").cast("long"))
    ends = [F.col(h) % (F.col("n") + 1) for h in ("__h1", "__h2")]
    rows = rows.withColumns({"__from": F.least(*ends).cast("int"), "__to": F.greatest(*ends).cast("int")})
    marked = F.col("__text").contains(PREFIX) | F.col("__text").contains(SUFFIX) | F.col("__text").contains(MIDDLE)
    plain = (F.col("n") == 0) | marked | (F.col("__h3") % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("__h4") % 100 < spm_percent, "spm").otherwise("psm"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("__units", start, size), ""))
    rows = rows.withColumns({
        "prefix": part(F.lit(1), F.col("__from")),
        "middle": part(F.col("__from") + 1, F.col("__to") - F.col("__from")),
        "suffix": part(F.col("__to") + 1, F.col("n").cast("int") - F.col("__to")),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("__text"))
    return rows.select(id_col, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A transformed text holds no marker of its own, so cuts at markers give its parts."""
    cut = F.split(output, "<[PSM]>", -1)
    psm = F.concat(cut[1], cut[3], cut[2])
    spm = F.concat(cut[2], cut[3], cut[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
