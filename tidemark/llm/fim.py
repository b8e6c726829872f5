"""Fill-in-middle examples: texts cut at unit boundaries found by zero-width splits, column functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = r"[\s\S]"


@dataclass(frozen=True)
class Closed:
    """Units that end with a character of a class: ``[^E]*[E]|[^E]+``."""

    end: str

    @property
    def grammar(self) -> str:
        return f"[^{self.end}]*[{self.end}]|[^{self.end}]+"

    @property
    def boundary(self) -> str:
        return f"(?<=[{self.end}])(?={ANY})"


@dataclass(frozen=True)
class Led:
    """Units with characters of a class in front of others: ``[L]*[^L]+|[L]+``."""

    lead: str

    @property
    def grammar(self) -> str:
        return f"[{self.lead}]*[^{self.lead}]+|[{self.lead}]+"

    @property
    def boundary(self) -> str:
        return f"(?<=[^{self.lead}])(?=[{self.lead}])"


@dataclass(frozen=True)
class Runs:
    """Units of characters of one class each: ``[A]+|[B]+|[^AB]+``."""

    classes: tuple[str, ...]

    @property
    def grammar(self) -> str:
        return "|".join([*(f"[{c}]+" for c in self.classes), f"[^{''.join(self.classes)}]+"])

    @property
    def boundary(self) -> str:
        inside = [f"(?<=[{c}])(?=[^{c}])" for c in self.classes]
        rest = "".join(self.classes)
        return "|".join([*inside, f"(?<=[^{rest}])(?=[{rest}])"])


@dataclass(frozen=True)
class Each:
    """Every character (code point) for itself."""

    grammar: str = ANY
    boundary: str = f"(?<={ANY})(?={ANY})"


#: Unit grammars by name. A text's units are the matches of ``grammar`` from the left; ``boundary`` matches between them.
UNITS = {"line": Closed(r"\n"), "sentence": Closed(".!?。"), "word": Led(r"\x20\x09-\x0D"), "run": Runs((r"\x20\x09-\x0D", "0-9", "A-Za-z_")), "character": Each()}
MARKERS = ("<P>", "<S>", "<M>")


def units(text: Column, unit: str = "line") -> Column:
    """The text in pieces, which joined give it again; an empty text has none (a split would give one empty piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, UNITS[unit].boundary, -1))


def _draw(seed: int, id_col: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the digest of seed and id, as a number."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), "utf-8"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _told_apart(markers: tuple[str, str, str]) -> None:
    both = [(a, b) for a in markers for b in markers]
    meet = any(a[-k:] == b[:k] for a, b in both for k in range(1, min(len(a), len(b))))
    if len({*markers, ""}) < 4 or meet or any(a != b and a in b for a, b in both):
        raise ValueError(f"markers {markers} must not be empty, equal, or overlap")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n, form, prefix, middle, suffix, output.

    A text of ``n`` units is cut before two of them or after the last, at places
    drawn from a digest of seed and id, so reruns agree and equal ids cut alike.
    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of these in the order suffix,
    prefix, middle (form spm), the others in the order prefix, suffix, middle (psm).
    Empty texts and those that hold a marker stay plain, with null parts; null
    texts count as empty, null ids as empty text. Ids may be of any type.
    """
    _told_apart(markers)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    h1, h2, h3, h4 = (_draw(seed, F.col("doc_id"), k) for k in (1, 2, 3, 4))
    held = F.contains("text", F.lit(markers[0])) | F.contains("text", F.lit(markers[1])) | F.contains("text", F.lit(markers[2]))
    plain = (F.col("text") == "") | held | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    cut = rows.withColumn("pieces", units(F.col("text"), unit)).withColumn("n", F.size("pieces").cast("long")).withColumn("form", form)
    cut = cut.withColumn("i", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).cast("int")).withColumn("j", F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).cast("int"))
    part = lambda a, b: F.when(F.col("form") != "plain", F.array_join(F.slice("pieces", a + 1, b - a), ""))
    i, j, n = F.col("i"), F.col("j"), F.col("n").cast("int")
    cut = cut.select("doc_id", "n", "form", "text", part(F.lit(0), i).alias("prefix"), part(i, j).alias("middle"), part(j, n).alias("suffix"))
    p, s, m = map(F.lit, markers)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return cut.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``transform`` made ``output`` of. No marker overlaps another and no text holds one, so the first of each is the one put in."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.instr(output, second), F.instr(output, m)
        start = len(first) + 1
        return F.substr(output, F.lit(start), a - start), F.substr(output, a + len(second), b - a - len(second)), F.substr(output, b + len(m))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))
