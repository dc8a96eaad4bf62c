"""Text columns: words, white space, names, slugs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


# English words that keyword search leaves out.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def collapsed(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def parent_name(fqname: Column) -> Column:
    """All before the last dot; null if there is none."""
    return F.when(fqname.contains("."), F.regexp_replace(fqname, r"\.[^.]*$", ""))


def slug(text: Column) -> Column:
    """Lower case, other than a-z and 0-9 to one hyphen, none at the ends, "section" if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("section"))


def cited_path(path: Column) -> Column:
    """As paths are compared in scoring: trimmed, leading dots and slashes gone, lower case."""
    return F.lower(F.ltrim(F.trim(path), F.lit("./")))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def iso(at: Column) -> Column:
    """A time in UTC as ISO 8601, null as empty."""
    return F.coalesce(F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def latency_ms(began: Column, ended: Column) -> Column:
    return F.unix_millis(ended.cast("timestamp")) - F.unix_millis(began.cast("timestamp"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as an unsigned number; null stays null."""
    raw = F.hex(text.cast("binary"))
    byte = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    none = F.array().cast("array<long>")
    octets = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), byte)).otherwise(none)
    return F.when(text.isNotNull(), F.aggregate(octets, F.lit(2166136261), lambda h, b: F.pmod(h.bitwiseXOR(b) * 16777619, F.lit(1 << 32))))


def _low_product(a: Column, b: Column) -> Column:
    """The lower 32 bits of a product of unsigned 32-bit numbers, without passing 64 bits."""
    return F.pmod(F.pmod(F.shiftright(a, 16) * b, F.lit(1 << 16)) * (1 << 16) + a.bitwiseAND(F.lit(0xFFFF)) * b, F.lit(1 << 32))


def mulberry32(seed: Column, n: Column | int) -> Column:
    """The n-th number (from 1) in [0, 1) of the Mulberry32 generator with a seed; the seed counts modulo 2^32."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    start = F.pmod(F.pmod(seed.cast("long"), F.lit(1 << 32)) + F.pmod(n * 0x6D2B79F5, F.lit(1 << 32)), F.lit(1 << 32))

    def drawn(a: Column) -> Column:
        t = _low_product(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))

        def mixed(t: Column) -> Column:
            u = F.pmod(t + _low_product(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61))), F.lit(1 << 32)).bitwiseXOR(t)
            return F.transform(F.array(u), lambda x: x.bitwiseXOR(F.shiftright(x, 14)) / F.lit(float(1 << 32)))[0]

        return F.transform(F.array(t), mixed)[0]

    return F.transform(F.array(start), drawn)[0]
