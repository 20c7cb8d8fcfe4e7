"""Fill-in-the-middle transformation of whole texts by zero-width splits, all in the JVM.

A unit grammar is translated to a regular expression that matches the empty places between two units:
each place is told from the classes of its two neighbours alone, so Spark's split() keeps every piece
whole. A text's pieces are then dealt to prefix, middle and suffix by two hashed cuts.

Edge cases: a null text counts as empty; an empty text has no units (split() would give one empty
piece) and stays plain; a text that holds a sentinel already stays plain, so every output is restored
exactly. A null id hashes as the empty string; rows with equal ids get the same cuts. Rows are never
joined or shuffled, so repeated rows and empty tables pass as they are; other columns of the table are
left alone by transform() and dropped by digest().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Of 100 documents so many are transformed, and of 100 transformed ones so many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


@dataclass(frozen=True)
class Units:
    """A grammar of units over code points.

    runs: classes (the inside of a bracket, disjoint from each other) whose members stay together;
    ends: a class whose members end a unit, everything before them included. A character of neither
    is a unit of its own, unless the grammar has ends only.
    """

    runs: tuple[str, ...] = ()
    ends: str = ""

    def boundary(self) -> str:
        """The zero-width places between two units, told by their neighbours' classes."""
        more = r"(?=[\s\S])"
        if self.ends:
            return f"(?<=[{self.ends}]){more}"
        alone = f"(?<=[^{''.join(self.runs)}]){more}" if self.runs else rf"(?<=[\s\S]){more}"
        return "|".join([alone, *(f"(?<=[{r}])(?=[^{r}])" for r in self.runs)])


#: `[A-Za-z]+|[^A-Za-z]`: words of ASCII letters, all else one by one.
WORDS = Units(runs=("A-Za-z",))
#: Every code point by itself.
CHARACTERS = Units()
#: Lines with their line feeds.
LINES = Units(ends=r"\n")
#: Words, numbers and stretches of white space whole; all else one by one.
MIXED = Units(runs=("A-Za-z", "0-9", r" \t\n\r\f\x0B"))


def pieces(text: Column, units: Units = WORDS) -> Column:
    """The units of a text in order, as an array; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, units.boundary(), -1))


def _group(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, units: Units = WORDS, seed: str = "1", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with a column fim: struct (n, form, prefix, middle, suffix, output); parts are null if plain.

    form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle). A clash of names is
    avoided inside; a column fim of docs is replaced.
    """
    whole, cut, dice = (fresh(x, docs.columns) for x in ("_whole", "_pieces", "_dice"))
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn(cut, pieces(F.col(whole), units)).withColumn(dice, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256))
    t, p = F.col(whole), F.col(cut)
    n = F.size(p).cast("long")
    a, b = _group(F.col(dice), 0) % (n + 1), _group(F.col(dice), 1) % (n + 1)
    low, high = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
    part = lambda start, length: F.array_join(F.slice(p, start + 1, length), "")
    held = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | held | (_group(F.col(dice), 2) % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(_group(F.col(dice), 3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    made = F.struct(
        n.alias("n"), form.alias("form"), part(F.lit(0), low).alias("prefix"), part(low, high - low).alias("middle"), part(high, F.size(p) - high).alias("suffix"),
    )
    rows = rows.withColumn("fim", made).drop(cut, dice)
    x = F.col("fim")
    order = {"psm": (PREFIX, "prefix", SUFFIX, "suffix", MIDDLE, "middle"), "spm": (SUFFIX, "suffix", PREFIX, "prefix", MIDDLE, "middle")}
    joined = {k: F.concat(*(x[y] if y in ("prefix", "suffix", "middle") else F.lit(y) for y in v)) for k, v in order.items()}
    output = F.when(x["form"] == "plain", t).when(x["form"] == "psm", joined["psm"]).otherwise(joined["spm"])
    only = lambda c: F.when(x["form"] != "plain", x[c]).alias(c)
    return rows.withColumn("fim", F.struct(x["n"].alias("n"), x["form"].alias("form"), only("prefix"), only("middle"), only("suffix"), output.alias("output"))).drop(whole)


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its parts lie between the sentinels, none of which a part can hold.

    A part's end and a sentinel never make another sentinel, as each begins with '<' and has no other.
    """
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    after = lambda mark: F.substr(body, F.locate(mark, body) + len(mark))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    psm = F.concat(before(body, SUFFIX), F.substring_index(after(SUFFIX), MIDDLE, -1), before(after(SUFFIX), MIDDLE))
    spm = F.concat(before(after(PREFIX), MIDDLE), F.substring_index(after(PREFIX), MIDDLE, -1), before(body, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each document."""
    x = F.col("fim")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs.select("doc_id", "text")).select(
        "doc_id", x["n"].alias("n"), x["form"].alias("form"), F.length(x["prefix"]).cast("long").alias("prefix_chars"), F.length(x["middle"]).cast("long").alias("middle_chars"),
        sha(x["output"]).alias("output_sha256"), sha(restore(x["output"], x["form"])).alias("restored_sha256"),
    )


#: The same rows in DuckDB's SQL.
ORACLE = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
dice AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
         ('0x' || d[25:32])::BIGINT AS h4
  FROM cut),
ends AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM dice),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m,
         coalesce(array_to_string(u[hi + 1:n], ''), '') AS s
  FROM ends)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
