"""Fill-in-middle transformation by counted quantifiers, with column functions only.

regexp_count gives the n units of a text. A pattern made for the row, a possessive unit{a} group, a possessive unit{b-a} group
and the rest, captures prefix, middle and suffix in one match, and the replacement of that match writes them in the order of
the form. Possessive groups never go back, so the match is one pass without recursion, whatever the length of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.operators.stage import computed

ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Format:
    """Unit pattern, sentinels, and shares in percent: `plain` of the texts stay as they are, `spm` of the others start with the suffix."""

    unit: str = "[A-Za-z]+|[^A-Za-z]"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 10
    spm: int = 20
    seed: int = 1

    def __post_init__(self) -> None:
        # A sentinel's first character in no other place: then no sentinel can begin in a text and end in a sentinel.
        whole = "".join(self.sentinels)
        if not all(s and whole.count(s[0]) == sum(t[0] == s[0] for t in self.sentinels) for s in self.sentinels) or len(set(self.sentinels)) < 3:
            raise ValueError("sentinels must differ, and their first characters must not occur inside of them")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def quoted(text: str) -> str:
    """A text as a pattern that matches just it."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def draws(id_col: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers: the first groups of eight digits of the SHA-256 of `seed:id`; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(count)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fmt: Format = Format()) -> DataFrame:
    """`docs` with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars and output.

    The draws of the id cut the text after a and b units: prefix, middle and suffix. psm writes sentinel and prefix, sentinel
    and suffix, sentinel and middle; spm the suffix first. Empty and null texts, texts that hold a sentinel, and the share
    `plain` are left as they are, with null lengths; a null text's output is empty. Rows are handled one by one: repeated
    rows and ids give equal results, null ids count as empty ones. All other columns stay; columns named as the added ones
    are replaced.
    """
    names = [c for c in docs.columns if c not in ADDED]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("t"), *[
        h.alias(f"h{k}") for k, h in enumerate(draws(F.col(f"`{id_col}`"), fmt.seed), 1)])
    marked = F.lit(False)
    for s in fmt.sentinels:
        marked = marked | F.contains("t", F.lit(s))
    plain = (F.col("t") == "") | marked | (F.pmod("h3", F.lit(100)) >= 100 - fmt.plain)
    form = F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < fmt.spm, "spm").otherwise("psm")
    counted = computed(held, {"n": F.regexp_count("t", F.lit(fmt.unit)).cast("bigint"), "form": form})
    x, y = F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)
    unit = f"(?:{fmt.unit})"
    pattern = F.concat(F.lit(rf"\A({unit}{{"), F.least(x, y).cast("string"), F.lit(rf"}}+)({unit}{{"),
                       F.abs(x - y).cast("string"), F.lit(r"}+)((?s:.*+))\z"))
    p, s, m = (k.replace("\\", "\\\\").replace("$", "\\$") for k in fmt.sentinels)
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    made = F.when(F.col("form") == "plain", F.col("t")).otherwise(F.regexp_replace("t", pattern, order))
    out = computed(counted.withColumn("pattern", pattern), {"output": made})
    # Lengths are read off the output: each sentinel occurs there once.
    at = {k: F.locate(k, F.col("output")) for k in fmt.sentinels}
    end = F.length("output") + 1
    psm = F.col("form") == "psm"
    lengths = {
        "prefix_chars": F.when(psm, at[fmt.suffix]).otherwise(at[fmt.middle]) - at[fmt.prefix] - len(fmt.prefix),
        "middle_chars": end - at[fmt.middle] - len(fmt.middle),
    }
    return out.select(
        *[F.col("row")[c].alias(c) for c in names], "n", "form",
        *[F.when(F.col("form") != "plain", v).cast("bigint").alias(c) for c, v in lengths.items()], "output")


def restored(output: Column, form: Column, fmt: Format = Format()) -> Column:
    """The text an output of a form was made from."""
    p, s, m = map(quoted, fmt.sentinels)
    # Up to the next sentinel: no step back, and a sentinel's first character inside the text is no end.
    part = r"((?s:(?!{}).)*+)"
    psm = rf"\A{p}{part.format(s)}{s}{part.format(m)}{m}((?s:.*+))\z"
    spm = rf"\A{s}{part.format(p)}{p}{part.format(m)}{m}((?s:.*+))\z"
    return F.when(form == "psm", F.regexp_replace(output, F.lit(psm), F.lit("$1$3$2"))).when(
        form == "spm", F.regexp_replace(output, F.lit(spm), F.lit("$2$3$1"))).otherwise(output)
