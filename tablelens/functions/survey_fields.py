"""Column expressions for the fields of survey records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens.functions import vocabulary as V
from tablelens.functions.values import field_key, name_key


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def survey_date(c: Column | str) -> Column:
    """``struct<date, valid>``: day first or ISO at the start of the text, years 1990 to 2100.

    An empty text is valid and has no date.
    """
    s = F.trim(F.coalesce(_c(c), F.lit("")))
    slashed, iso = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\d)", r"^(\d{4})-(\d{2})-(\d{2})"
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    year = F.when(F.length(part(slashed, 3)) == 2, F.concat(F.lit("20"), part(slashed, 3))).otherwise(part(slashed, 3))
    text = F.when(s.rlike(slashed), F.concat_ws("-", year, part(slashed, 2), part(slashed, 1))).when(
        s.rlike(iso), F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3))
    )
    day = F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")
    known = F.when(F.year(day).between(1990, 2100), day)
    return F.struct(known.alias("date"), ((s == "") | known.isNotNull()).alias("valid"))


def _by_words(key: Column, words: dict[str, list[str]]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, spellings in words.items():
        out = out.when(key.isin(spellings), value)
    return out


def exam_result(c: Column | str) -> Column:
    """``struct<value, recognized>``; one wrong letter in the two main results is forgiven."""
    key = field_key(F.coalesce(_c(c), F.lit("")))
    typo = lambda word: (F.length(key) >= 6) & (F.levenshtein(key, F.lit(word), 1) >= 0)
    found = F.coalesce(
        F.when(key == "", V.NOT_INFORMED),
        _by_words(key, V.EXAM_WORDS),
        F.when(typo("negativo"), "negativo"),
        F.when(typo("positivo"), "positivo"),
    )
    return F.struct(F.coalesce(found, F.lit(V.NOT_INFORMED)).alias("value"), found.isNotNull().alias("recognized"))


def search_result(c: Column | str) -> Column:
    """``struct<value, recognized>``."""
    key = field_key(F.coalesce(_c(c), F.lit("")))
    found = F.coalesce(F.when(key == "", V.NOT_INFORMED), _by_words(key, V.SEARCH_WORDS))
    return F.struct(F.coalesce(found, F.lit(V.NOT_INFORMED)).alias("value"), found.isNotNull().alias("recognized"))


def channel(c: Column | str) -> Column:
    key = field_key(_c(c))
    return F.when(key.startswith("pit"), "pit").when(key.startswith("captura") | key.startswith("campanha"), "captura")


def environment(c: Column | str) -> Column:
    key = field_key(_c(c))
    intra, peri = key.rlike(r"\bintra"), key.rlike(r"(^|_)peri")
    return F.when(intra & peri, "intra_peri").when(intra, "intra").when(peri, "peri")


def stage_and_sex(c: Column | str) -> Column:
    """``struct<stage, sex>`` from one combined field."""
    key = field_key(F.coalesce(_c(c), F.lit("")))
    nymph, male, female = (key.contains(w) for w in ("ninfa", "macho", "femea"))
    adult = male | female
    return F.struct(
        F.when(nymph & adult, "Ninfa e adulto").when(nymph, "Ninfa").when(adult, "Adulto").alias("stage"),
        F.when(male & female, "Macho e Fêmea").when(male, "Macho").when(female, "Fêmea").alias("sex"),
    )


def species_of(name: Column | str, patterns: list[tuple[str, str]] = V.SPECIES_PATTERNS) -> Column:
    key = field_key(F.regexp_replace(_c(name), r"(?i)\bP\.\s*$", ""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, value in patterns:
        out = out.when(key.rlike(pattern), value)
    return out


def clean_locality(name: Column | str) -> Column:
    """A place name without trailing code and start/end marks."""
    s = F.regexp_replace(_c(name), r"[\s/\\.,;:–-]+$", "")
    s = F.regexp_replace(s, V.CODE_AND_MARK_AT_END, "")
    s = F.regexp_replace(s, V.MARK_AT_END, "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def has_end_marker(name: Column | str) -> Column:
    return _c(name).rlike(V.NUMBERED_MARK) | _c(name).rlike(V.CODED_NAME)


# ------------------------------------------------------------------ field labels


def _lookup(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical_fields(pairs: Column | str, user_map: dict[str, str] | None = None) -> Column:
    """``array<struct<key, value, canon, personal>>`` for the key/value pairs of a record.

    A mapping by the user wins; personal fields have no canonical name and are marked.
    """
    from tablelens.functions.values import _FOLD_FROM, _FOLD_TO
    import re

    def plain(text: str) -> str:
        folded = text.lower().translate(str.maketrans(_FOLD_FROM[: len(_FOLD_TO)], _FOLD_TO))
        return re.sub(r"[^a-z0-9]+", "_", folded).strip("_")

    aliases: dict[str, str] = {}
    for canon, names in V.FIELD_ALIASES.items():
        for n in names:
            aliases.setdefault(n, canon)
    for n in V.IGNORED_FIELDS:
        aliases.setdefault(n, "ignorar")
    users = {plain(k): v for k, v in (user_map or {}).items()}
    source = F.col(pairs) if isinstance(pairs, str) else pairs

    def named(p: Column) -> Column:
        key = field_key(p["key"])
        chosen = _lookup(users, key)
        personal = chosen.isNull() & key.isin(V.PERSONAL_FIELDS)
        return F.struct(
            p["key"].alias("key"),
            F.when(~personal, p["value"]).alias("value"),
            F.when(~personal, F.coalesce(chosen, _lookup(aliases, key))).alias("canon"),
            personal.alias("personal"),
        )

    return F.transform(source, named)


def canonical_value(fields: Column | str, canon: str) -> Column:
    """The first non-empty value of a canonical field; empty text when it is only ever empty."""
    f = F.col(fields) if isinstance(fields, str) else fields
    mine = F.filter(f, lambda p: p["canon"] == canon)
    return F.coalesce(
        F.get(F.filter(mine, lambda p: p["value"] != ""), F.lit(0))["value"], F.get(mine, F.lit(0))["value"]
    )


# ------------------------------------------------------------------ folders


def folder_type(path: Column | str) -> Column:
    """Record type guessed from the innermost folder whose name tells one."""
    p = F.col(path) if isinstance(path, str) else path

    def guess(folder: Column) -> Column:
        key, out = name_key(folder), F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, value in V.FOLDER_TYPE_PATTERNS:
            out = out.when(key.rlike(pattern), value)
        return out

    return F.try_element_at(F.array_compact(F.transform(p, guess)), F.lit(-1))


def place_folder(path: Column | str) -> Column:
    """The innermost folder whose name is not a kind of record."""
    p = F.col(path) if isinstance(path, str) else path
    return F.try_element_at(F.filter(p, lambda f: ~name_key(f).rlike(V.TYPE_FOLDER)), F.lit(-1))


def is_boundary_name(c: Column, places: tuple[str, ...] = ()) -> Column:
    """A name that tells the outline of the area: a word for it, or exactly one of ``places``."""
    key = name_key(c)
    named = [key == name_key(F.lit(p)) for p in places]
    out = key.rlike(V.BOUNDARY_NAME)
    for same in named:
        out = out | same
    return out
