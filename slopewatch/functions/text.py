"""Text: accents, markup, codes and keywords."""

from __future__ import annotations

import html.entities
import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DISTRICTS, EXTRA_ALIASES, RURAL_TO_MODEL, lookup

# Keywords of the live, the historical and the incremental article feed.
LIVE_WORDS = ["deslizamiento", "deslizamientos", "movimiento en masa", "movimientos en masa", "derrumbe", "derrumbes"]
BACKFILL_WORDS = ["desliz", "movimiento en masa", "movimientos en masa", "derrumbe", "emergencia", "avenida torrencial"]
INCREMENTAL_WORDS = ["desliz", "movimiento en masa", "derrumbe", "emergencia", "avenida torrencial"]

# What an assistant says when it doesn't answer.
REFUSALS = [
    "no puedo ayudar",
    "no puedo asistir",
    "no tengo acceso",
    "no tengo informacion especifica",
    "necesito mas detalles",
    "necesito mas informacion",
    "podriamos tener mas informacion",
    "podriamos tener mas detalles",
    "podrias tener mas informacion",
    "cual es su area geografica",
    "cual es el numero de habitantes",
    "pregunta especifica",
    "podrias proporcionar mas",
    "podria proporcionar mas",
]


def without_marks(text: str) -> str:
    """The text decomposed, without its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1)
def marked_letters() -> tuple[str, str]:
    """All lower-case letters up to U+3100 that are a letter with marks, and that letter."""
    pairs = [(c, without_marks(c)) for c in map(chr, range(0x80, 0x3100)) if unicodedata.category(c) != "Mn" and c.lower() == c]
    pairs = [(c, plain) for c, plain in pairs if len(plain) == 1 and plain != c]
    return "".join(c for c, _ in pairs), "".join(plain for _, plain in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents: letters with marks become plain ones, marks of their own go."""
    return F.regexp_replace(F.translate(F.lower(text), *marked_letters()), r"\p{Mn}+", "")


def any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def refuses(text: Column) -> Column:
    return any_of(fold(text), REFUSALS)


@lru_cache(maxsize=1)
def _named() -> tuple[str, str]:
    """Names of character references by their first letter, as JSON, and a pattern of those that need no semicolon."""
    by: dict[str, dict[str, str]] = {}
    for name, sign in html.entities.html5.items():
        by.setdefault(name[0], {})[name] = sign
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(by), f"^(?:{'|'.join(bare)})"


def _windows(code: int) -> str:
    """What a reference to a control character of the upper range means: the sign of that byte in Windows-1252."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def _sign(code: Column) -> Column:
    """The character of a code point as browsers read it: none for controls and non-characters, the replacement character
    for what is no code point."""
    control = code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | code.bitwiseAND(F.lit(0xFFFE)).eqNullSafe(0xFFFE)
    upper = F.create_map(*[F.lit(x) for c in range(0x80, 0xA0) for x in (c, _windows(c))])
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    lost = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(lost, "\ufffd").when(code.between(0x80, 0x9F), F.element_at(upper, code.cast("int"))).when(control, "").otherwise(plain)


def unescape(text: Column) -> Column:
    """Character references decoded once, as browsers do: all names of HTML 5, with or without a semicolon where that may
    be missing, decimal and hexadecimal numbers.  What is no reference stays."""
    named, bare = _named()
    names = F.from_json(F.lit(named), "map<string,map<string,string>>")  # a constant

    def numbered(rest: Column, pattern: str, base: int) -> tuple[Column, Column, Column]:
        whole = F.regexp_extract(rest, pattern, 0)
        digits = F.ltrim(F.regexp_extract(rest, pattern, 1), F.lit("0"))
        code = F.when(digits == "", 0).when(F.length(digits) > 7, 0x110000).otherwise(F.conv(digits, base, 10).cast("long"))
        return whole != "", _sign(code), whole

    def decoded(rest: Column) -> Column:
        """What follows an ampersand, with the reference that it begins with decoded."""
        is_hex, hexed, hex_text = numbered(rest, "^#[xX]([0-9a-fA-F]+);?", 16)
        is_number, sign, number_text = numbered(rest, "^#([0-9]+);?", 10)
        own = F.element_at(names, F.left(rest, F.lit(1)))
        exact = F.regexp_extract(rest, "^[A-Za-z][A-Za-z0-9]*;", 0)
        short = F.regexp_extract(rest, bare, 0)

        def instead(text: Column, sign: Column) -> Column:
            return F.concat(sign, F.substring(rest, F.length(text) + 1, F.length(rest)))

        return (
            F.when(F.startswith(rest, F.lit("#")), F.when(is_hex, instead(hex_text, hexed)).when(is_number, instead(number_text, sign)).otherwise(F.concat(F.lit("&"), rest)))
            .when(F.element_at(own, exact).isNotNull(), instead(exact, F.element_at(own, exact)))
            .when(short != "", instead(short, F.element_at(own, short)))
            .otherwise(F.concat(F.lit("&"), rest))
        )

    pieces = F.split(text, "&")
    read = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), read).otherwise(text)


def strip_html(html: Column) -> Column:
    """Text nodes joined by one space; character references decoded, white space (no-break spaces too) made one space."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    text = unescape(F.regexp_replace(text, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(text, r"[\s\u00A0]+", " "))


def count_links(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href"))


def commune_from_text(text: Column) -> Column:
    """District number after the word for one; else the model id of a rural code after the word for that."""
    urban = F.regexp_extract(text, r"(?i)comuna\s*(\d{1,2})\b", 1)
    rural = F.regexp_extract(text, r"(?i)corregimiento\s*(\d{2,3})\b", 1)
    return F.when(urban != "", urban.try_cast("int").cast("string")).otherwise(lookup(RURAL_TO_MODEL, rural))


def commune_from_station(field: Column) -> Column:
    """First one or two digits: 1 to 16 as they are, rural codes as model ids, else null."""
    n = F.regexp_extract(field, r"(\d{1,2})", 1).try_cast("int")
    return F.when(n.between(1, 16), n.cast("string")).otherwise(lookup(RURAL_TO_MODEL, n.cast("string")))


def model_commune(code: Column) -> Column:
    """Official code to model id: none for codes that begin with SN, rural codes mapped, leading zeros cut."""
    digits = F.trim(code)
    plain = F.when(digits.rlike(r"^\d+$"), digits.try_cast("long").cast("string")).otherwise(code)
    return F.when((code == "") | code.startswith("SN"), None).otherwise(F.coalesce(lookup(RURAL_TO_MODEL, code), plain))


def digits_only(text: Column) -> Column:
    """All digits of a text joined and without leading zeros; null without any."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits != "", digits.try_cast("long").cast("string"))


def two_digits(code: Column) -> Column:
    return F.lpad(code.try_cast("int").cast("string"), 2, "0")


def aliases() -> dict[str, str]:
    """Folded district names, ids and extra spellings to ids."""
    out = {}
    for i, name, _ in DISTRICTS:
        out[without_marks(name.lower())] = i
        out[i] = i
    for alias, i in EXTRA_ALIASES.items():
        out.setdefault(alias, i)
    return out


def resolve_alias(text: Column) -> Column:
    """A folded name or alias to its id; any number passes."""
    key = F.trim(fold(text))
    return F.when(key.rlike(r"^\d+$"), key).otherwise(lookup(aliases(), key))


def _of_size(words: Column, between: Column, n: int, names: dict[str, str]) -> Column:
    """(word, less, id) of the first places of the aliases of n words."""
    begin, known = sorted({re.match(r"[a-z0-9]+", a)[0] for a in names}), sorted(names)

    def hits(grams: Column, place) -> Column:
        found = F.array_distinct(F.filter(grams, lambda g: F.coalesce(g.isin(known), F.lit(False))))
        return F.transform(found, lambda a: F.struct(place(F.array_position(grams, a)).cast("int").alias("word"), (-F.length(a)).alias("less"), lookup(names, a).alias("id")))

    if n == 1:
        return hits(words, lambda i: i)
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(begin))
    starts = F.when(F.size(words) >= n, starts).otherwise(F.array().cast("array<int>"))

    def gram(i: Column) -> Column:
        parts = [F.get(words, i - 1)]
        for k in range(1, n):
            parts += [F.get(between, i - 1 + k), F.get(words, i - 1 + k)]
        return F.concat(*parts)

    both = F.array(F.struct(starts.alias("starts"), F.transform(starts, gram).alias("grams")))  # made once
    return F.element_at(F.transform(both, lambda x: hits(x["grams"], lambda i: F.element_at(x["starts"], i.cast("int")))), 1)


def mentions(text: Column, names: dict[str, str]) -> Column:
    """Ids whose alias stands in the text between other signs than letters and digits, each id once at its first place, as
    an array of (position, id) by position; of two that begin at one place the longer alias comes first.

    The folded text is cut into words (runs of a-z and 0-9) once, and each word is looked up in a set, so the time doesn't
    grow with the number of aliases.  Where a word begins an alias of several words, that many words with the signs
    between them are looked up.  An alias that doesn't begin and end with such a letter or digit is searched for by itself.
    A null text names none.
    """
    whole = {a: i for a, i in names.items() if re.fullmatch(r"[a-z0-9](.*[a-z0-9])?", a, re.S)}
    sizes: dict[int, dict[str, str]] = {}
    for alias, i in whole.items():
        sizes.setdefault(len(re.findall(r"[a-z0-9]+", alias)), {})[alias] = i
    none = F.array().cast("array<struct<word:int,less:int,id:string>>")

    def search(folded: Column) -> Column:
        return F.element_at(F.transform(F.array(F.struct(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), 0).alias("words"), F.split(folded, "[a-z0-9]+").alias("between"), folded.alias("text"))), found), 1)

    def found(t: Column) -> Column:
        words, between = t["words"], t["between"]
        hits = F.concat(none, *[_of_size(words, between, n, own) for n, own in sorted(sizes.items())])

        def position(word: Column) -> Column:
            before = F.aggregate(F.slice(words, 1, word - 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(between, 1, word), F.lit(0), lambda s, x: s + F.length(x))
            return (before + 1).cast("long")

        ordered = F.array_sort(hits)
        first = F.transform(F.array_distinct(F.transform(ordered, lambda h: h["id"])), lambda i: F.element_at(F.filter(ordered, lambda h: h["id"] == i), 1))
        out = F.transform(first, lambda h: F.struct(position(h["word"]).alias("position"), h["less"].alias("less"), h["id"].alias("id")))
        odd = [(a, i) for a, i in names.items() if a and a not in whole]
        if odd:
            more = [F.struct(F.regexp_instr(t["text"], F.lit(rf"(?<![a-z0-9])\Q{a}\E(?![a-z0-9])")).cast("long").alias("position"), F.lit(-len(a)).alias("less"), F.lit(i).alias("id")) for a, i in odd]
            every = F.array_sort(F.concat(out, F.filter(F.array(*more), lambda x: x["position"] > 0)))
            out = F.transform(F.array_distinct(F.transform(every, lambda h: h["id"])), lambda i: F.element_at(F.filter(every, lambda h: h["id"] == i), 1))
        return F.transform(out, lambda h: F.struct(h["position"].alias("position"), h["id"].alias("id")))

    nothing = F.array().cast("array<struct<position:long,id:string>>")
    return F.coalesce(F.element_at(F.transform(F.array(fold(text)), search), 1), nothing)  # folds the text once


def title(text: Column, most: int = 500, default: str = "sin titulo") -> Column:
    return F.coalesce(F.when(F.trim(text) != "", F.left(F.trim(text), F.lit(most))), F.lit(default))


def row_id(prefix: str, kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:{kind}:"), number.cast("string"))
