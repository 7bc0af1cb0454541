"""Column builders for names, words and text clean-up. All run inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file-name grammar, copy suffixes, variants, extensions.
GRAMMAR = r"^([A-Z0-9]{4})(\d{2})(\d{2})(HD)?(?:_REV(\d{8}))?(_[A-Z0-9]+)?$"
VARIANTS = ("PLEDGE", "DS")
COPY_SUFFIXES = (r"(?i)\s*-\s*Copy(?:\s*\((\d+)\))?\s*$", r"(?i)\s+copy(?:\s+(\d+))?\s*$", r"\s*\((\d+)\)\s*$")
MEDIA_ID = r"(?i)([A-Z0-9]{4}\d{4}(?:[A-Z]+\d{0,2})?)"
FILE_TYPES = {"mp4": "mp4", "mov": "mp4", "mxf": "mp4", "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "srt": "srt", "scc": "scc"}


#: What starts a line of a formatted document, and what signs one.
CONTENT_MARKS, SIGNATURE, RULE_LINE, PROVENANCE = r"^(```|#\s|\*\*|---|<!--)", r"^\*\*(Model|Creator|Agent):\*\*", r"^-{3,}\s*$", r"^<!--\s*model:"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, even where use has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def group(column: Column, pattern: str, i: int = 1) -> Column:
    """A regex group, null where it doesn't match."""
    return F.nullif(F.regexp_extract(column, pattern, i), F.lit(""))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(group(name, r"\.([^.]*)$"))


def parse_filename(name: Column) -> Column:
    """Struct of the parts of a media file name; outcome is parsed, unmatched (the prefix table decides further) or bad_date."""
    upper = F.upper(stem(name))
    # one match for all parts: the groups side by side, or an array of one where the grammar doesn't match
    parts = F.split(F.regexp_replace(upper, GRAMMAR, "$1\n$2\n$3\n$4\n$5\n$6"), "\n")

    # what several fields ask for is computed once
    facts = lambda p: F.struct(p.alias("p"), (F.size(p) == 6).alias("matched"), F.to_date(F.try_to_timestamp(F.nullif(F.get(p, F.lit(4)), F.lit("")), F.lit("yyyyMMdd"))).alias("day"))

    def read(x: Column) -> Column:
        part = lambda i: F.nullif(F.get(x["p"], F.lit(i)), F.lit(""))
        tag, ok = F.substring(part(5), 2, 1000), x["matched"] & (part(4).isNull() | x["day"].isNotNull())
        keep = lambda c: F.when(ok, c)
        return F.struct(
            F.when(~x["matched"], "unmatched").when(ok, "parsed").otherwise("bad_date").alias("outcome"), keep(F.concat(part(0), part(1), part(2))).alias("media_id"), F.coalesce(keep(part(0)), F.substring(F.concat_ws("", x["p"]), 1, 4)).alias("prefix"),
            keep(part(1).cast("int")).alias("season"), keep(part(2).cast("int")).alias("episode"), keep(part(3).isNotNull()).alias("hd"), keep(x["day"]).alias("revision_date"),
            keep(F.when(tag.isin(*VARIANTS), tag)).alias("variant_tag"), keep(F.when(~tag.isin(*VARIANTS), tag)).alias("unknown_tag"),
        )

    return let(parts, lambda p: let(facts(p), read))


def without_copy_suffix(name: Column) -> Column:
    """The first copy suffix that matches, of three in order, goes."""
    out = name
    for pattern in reversed(COPY_SUFFIXES):
        out = F.when(name.rlike(pattern), F.trim(F.regexp_replace(name, pattern, ""))).otherwise(out)
    return out


def media_id(name: Column) -> Column:
    """Media id of a transcript name, with its revision; else the clean stem if it has no space; else null."""
    clean = F.regexp_replace(without_copy_suffix(stem(name)), "(?i)_ForClaude", "")
    base, revised = group(clean, MEDIA_ID), group(clean, MEDIA_ID + r"_REV\d+", 0)
    good = base.isNotNull() & ~F.startswith(F.upper(base), F.lit("REV"))
    revised = F.when(~F.startswith(F.upper(revised), F.lit("REV")), F.upper(revised))
    return F.when(good, F.coalesce(revised, F.upper(base))).when(~F.contains(clean, F.lit(" ")), F.nullif(clean, F.lit("")))


def media_id_of_url(url: Column) -> Column:
    """As media_id, for an encoded URL's last part; + stays +, and doubled extensions go first."""
    name = F.url_decode(F.replace(F.element_at(F.split(url, "/"), -1), F.lit("+"), F.lit("%2B")))
    return media_id(F.regexp_replace(name, r"(?i)(\.srt|\.txt)\1$", "$1"))


def path_component(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}\-_. ]", "_"), "_{2,}", "_")
    clean = F.rtrim(F.substring(F.regexp_replace(clean, "^[_ ]+|[_ ]+$", ""), 1, 200))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unnamed"))


def size_bytes(text: Column, negatives: bool = False) -> Column:
    """Bytes of a listing's size cell such as 96K or 1.8G; null for a dash, nonsense and (unless asked for) negatives."""
    unit = F.upper(F.right(F.trim(text), F.lit(1)))
    power = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)
    number = F.regexp_replace(F.trim(text), "(?i)[KMG]$", "").try_cast("double")
    value = (number * power).cast("long")
    return value if negatives else F.when(number >= 0, value)


def file_type(name: Column) -> Column:
    out = F.lit("other")
    for ext, kind in FILE_TYPES.items():
        out = F.when(extension(name) == ext, kind).otherwise(out)
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def excerpt(text: Column, size: int = 40) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def truncated(text: Column, limit: Column | int) -> Column:
    """At most limit characters, cut at a word's end, with an ellipsis."""
    cut = F.rtrim(F.regexp_replace(F.left(text, (F.lit(limit) - 1).cast("int")), r"\s\S*\z", ""))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("…"))).otherwise(text)


def tokens(text: Column) -> Column:
    """Words, with inner apostrophes and hyphens, or single marks."""
    return F.regexp_extract_all(text, F.lit(r"(?U)([\w'’\-]+|[^\w\s])"), 1)


def trigrams(text: Column) -> Column:
    """The set of 3-grams of lower-case words of three letters or more."""
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, F.lit(3)), " ")))
    return let(F.regexp_extract_all(F.lower(text), F.lit("([a-z']{3,})"), 1), lambda w: F.when(F.size(w) >= 3, grams(w)).otherwise(F.array().cast("array<string>")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def content_words(text: Column) -> Column:
    """Words of a formatted document's body: its lines after the first rule line (all where there is none), without comments and the status line.

    A word counts by what is left of it without emphasis marks; heading marks are no words.
    """
    spoken = lambda line: F.filter(F.split(F.replace(line, F.lit("*"), F.lit("")), r"\s+"), lambda w: (w != "") & ~w.rlike(r"^#{1,6}$"))
    status = lambda line: F.replace(line, F.lit("*"), F.lit("")).rlike(r"^Status:\s")
    lines = F.split(F.array_join(F.transform(F.split(text, "<!--"), lambda part, i: F.when(i == 0, part).otherwise(F.when(F.contains(part, F.lit("-->")), F.substr(part, F.instr(part, F.lit("-->")) + 3)).otherwise(F.concat(F.lit("<!--"), part)))), ""), "\n")

    def body(all_lines: Column) -> Column:
        rule = F.array_position(F.transform(all_lines, lambda x: x.rlike(RULE_LINE)), True).cast("int")
        return F.aggregate(F.filter(all_lines, lambda x, i: (i >= rule) & ~status(x)), F.lit(0), lambda n, x: n + F.size(spoken(x)))

    return let(lines, body)


def source_words(srt: Column) -> Column:
    """Words of an SRT text's dialogue: no numbers on their own line, no times."""
    words = lambda line: F.filter(F.split(line, r"\s+"), lambda w: w != "")
    return F.aggregate(F.filter(F.split(srt, "\n"), lambda x: ~x.rlike(r"^\d+[ \t]*$") & ~x.rlike(r"^\d{1,2}:\d\d:\d\d[,.]\d{3}\s*-->")), F.lit(0), lambda n, x: n + F.size(words(x)))


def srt_plain(srt: Column) -> Column:
    keep = F.filter(F.split(srt, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\d+\s*$") & ~F.contains(x, F.lit("-->")))
    return F.array_join(F.transform(keep, lambda x: F.trim(x)), " ")


def without_reasoning(text: Column) -> Column:
    """No think blocks, no text up to a dangling end mark, no outer code fence."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?s)\A.*?</think>", "")
    return strip(F.regexp_replace(strip(out), r"(?s)\A```[a-z]*\n(.*?)\n?```\z", "$1"))


def clean_chunk(text: Column) -> Column:
    """text without what models put around it: a provenance line, talk before the first marked line, a fence around all, signatures, a rule at the end.

    Told by the places of lines: the first with a mark, the fence that it opens, the last that says something.
    """

    # what a lambda reads for each line is computed once before it
    def kept(lines: Column) -> Column:
        def bounds(marked: Column) -> Column:
            fenced = F.coalesce(F.get(lines, marked - 1).rlike(r"^```(markdown|md)?\s*$"), F.lit(False)) & (marked > 0)
            closing = F.size(lines) - F.coalesce((fenced & F.element_at(lines, -1).rlike(r"^```\s*$") & (F.size(lines) > marked)).cast("int"), F.lit(0))
            first = F.when(fenced, marked).otherwise(F.greatest(marked, F.lit(1)) - 1)
            return F.struct(first.alias("first"), closing.alias("closing"))

        marked = F.array_position(F.transform(lines, lambda x: x.rlike(CONTENT_MARKS)), True).cast("int")
        inner = let(let(marked, bounds), lambda e: F.filter(F.slice(lines, e["first"] + 1, F.greatest(e["closing"] - e["first"], F.lit(0))), lambda x: ~x.rlike(SIGNATURE)))
        says = lambda ls: F.array_max(F.transform(ls, lambda x, i: F.when(~x.rlike(RULE_LINE) & (F.trim(x) != ""), i + 1).otherwise(0)))
        return let(inner, lambda ls: F.array_join(F.slice(ls, F.lit(1), F.coalesce(says(ls), F.lit(0))), "\n"))

    # a provenance comment is the first line
    body = lambda lines: F.when(F.get(lines, F.lit(0)).rlike(PROVENANCE), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    return strip(let(let(F.split(strip(text), "\n"), body), kept))


def model_family(model: Column) -> Column:
    m = F.lower(model)
    return F.when(F.contains(m, F.lit("haiku")), "haiku").when(F.contains(m, F.lit("sonnet")), "sonnet").when(F.contains(m, F.lit("opus")), "opus")


def next_family(family: Column) -> Column:
    return F.when(family == "haiku", "sonnet").when(family == "sonnet", "opus")
