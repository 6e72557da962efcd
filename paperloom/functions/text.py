"""Text expressions (X1, X2, X4-X8, X10, X11, X13, X16, X18, X22-X28, X30, P4, P16, P22, P29, D1, D2), all as Spark columns."""

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that text recognition confuses, with the letter they stand for.
OCR_FROM, OCR_TO = "01|!58@347()", "ollisbaeatcj"
CURRENCY = "€$%£¥"
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
# Names of confidences.
CONFIDENCES = {"alta": 0.85, "high": 0.85, "média": 0.65, "media": 0.65, "medium": 0.65, "baixa": 0.35, "low": 0.35, "muito alta": 0.95, "very high": 0.95, "muito baixa": 0.15, "very low": 0.15}
# Patterns of the signals in a page.
DATES = r"(?iu)\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b\d{1,2}\s+de\s+(?:" + "|".join(MONTHS) + r")\s+de\s+\d{4}\b"
AMOUNTS = r"(?iu)€\s*[\d.,]+|\bEUR\s*[\d.,]+|[\d.,]+\s*€|[\d.,]+\s*euros?\b"
LAWS = r"(?iu)\bart(?:igo)?\.?\s*\d+[º°]?(?:\s*,?\s*n\.?[º°]?\s*\d+)?|\b(?:DL|D\.?L\.?|Decreto[- ]Lei)\s*n\.?[º°]?\s*\d+[/-]\d+|\bLei\s*n\.?[º°]?\s*\d+[/-]\d+|\bC(?:ódigo)?\s*(?:Civil|Penal|Trabalho|Processo)"
TAX_IDS = r"(?iu)\b(?:NIF|NIPC|CPF|CC)\s*(?:n\.?[º°]?\s*)?\d{9}\b"
CASES = r"(?iu)\bProc(?:esso)?\.?\s*n\.?[º°]?\s*\d{1,5}[/.]\d{2,4}(?:\.\d+)?(?:[A-Z]{2,6})?|\b\d{1,5}/\d{2,4}\.\d+[A-Z]{2,6}\b"
ENTITIES = {"date": DATES, "amount": AMOUNTS, "law": LAWS, "case": CASES, "tax_id": TAX_IDS}


@cache
def _bare(form: str) -> tuple[str, str, dict[str, str]]:
    """What a form of Unicode leaves of each character without combining marks: characters that become one other, what
    they become, and behind them those that vanish; and those that become several. Hangul syllables stay as they are."""
    one, gone, several = {}, [], {}
    for c in map(chr, range(0x80, 0x110000)):
        if "\ud800" <= c <= "\udfff" or "\uac00" <= c <= "\ud7a3":
            continue
        left = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if not left:
            gone.append(c)
        elif len(left) > 1:
            several[c] = left
        elif left != c:
            one[c] = left
    return "".join(one) + "".join(gone), "".join(one.values()), several


def _near(characters) -> str:
    """A pattern of few ranges that holds the characters, and some others between them."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if ranges and c - ranges[-1][1] <= 64:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def unaccented(t: Column, form: str = "NFKD") -> Column:
    """Lower-cased text without combining marks, decomposed by a form of Unicode: NFKD also takes ligatures and the like
    apart, NFD doesn't."""
    old, new, several = _bare(form)
    if several:
        apart = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
        letters = F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(apart, c), c))
        t = F.when(t.rlike(_near(several)), F.array_join(letters, "")).otherwise(t)
    return F.lower(F.translate(t, old, new))


def for_matching(t: Column, ocr: bool = True) -> Column:
    """No accents; confused characters as letters where no digit is beside them; lower case; white space collapsed;
    no marks but currency signs; trimmed."""
    out = unaccented(t, "NFD")
    if ocr:
        for a, b in zip(OCR_FROM, OCR_TO, strict=True):
            out = F.regexp_replace(out, r"(?<!\d)\Q" + a + r"\E(?!\d)", b)
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s" + CURRENCY + "]", ""))


def words(t: Column) -> Column:
    """Distinct words of a text, in order."""
    return F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if there are none."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / n)


def containment(needle: Column, hay: Column, least: float) -> Column:
    """How a normalised excerpt is in a text: substring, word_subset, overlap (share of words at least ``least``)
    or none, with the share."""
    n, h = words(needle), words(hay)
    share = F.size(F.array_intersect(n, h)).cast("double") / F.greatest(F.size(n), F.lit(1))
    method = F.when(needle == "", "none").when(hay.contains(needle), "substring").when(F.size(F.array_except(n, h)) == 0, "word_subset").when(share >= least, "overlap").otherwise("none")
    return F.struct(method.alias("method"), F.when(method == "substring", F.lit(1.0)).otherwise(share).alias("share"))


def semantic_hash(t: Column) -> Column:
    """md5 of the text without accents, case, marks and extra white space."""
    return F.md5(F.trim(F.regexp_replace(F.regexp_replace(unaccented(t), r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", " ")))


def positional_similarity(a: Column, b: Column) -> Column:
    """X11: 0.4 of the share of equal characters at equal places, and 0.6 of the Jaccard similarity of words."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    n = F.greatest(F.length(a), F.length(b))
    place = F.when(n == 0, F.lit(0.0)).otherwise(same.cast("double") / n)
    return 0.4 * place + 0.6 * jaccard(words(F.lower(a)), words(F.lower(b)))


def matches(t: Column, pattern: str) -> Column:
    """Array of (text, start, end) of a pattern's matches, from what stands between them."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    between = F.split(t, pattern, -1)
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    start = lambda i: size(F.slice(between, 1, i + 1)) + size(F.slice(found, 1, i))
    return F.transform(found, lambda m, i: F.struct(m.alias("text"), start(i).alias("start"), (start(i) + F.length(m)).alias("end")))


def item_id(kind: Column, value: Column, doc: Column, start: Column) -> Column:
    """12 hex digits of the sha-256 of type:value:doc:start."""
    return F.substring(F.sha2(F.concat_ws(":", kind, value, doc.cast("string"), start.cast("string")), 256), 1, 12)


def chunk_id(doc: Column, index: Column) -> Column:
    """doc_c0003."""
    return F.concat(doc.cast("string"), F.lit("_c"), F.lpad(index.cast("string"), 4, "0"))


def amount(t: Column) -> Column:
    """1.234,50 as 1234.50 without currency characters; the text itself where that is no number."""
    bare = F.replace(F.replace(F.regexp_replace(t, "(?i)[€EURurosS\\s]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(bare.try_cast("decimal(18,2)").cast("string"), t)


def confidence(t: Column) -> Column:
    """A confidence in words or digits, held to 0..1; 0.5 for anything else."""
    named = F.create_map(*[x for k, v in CONFIDENCES.items() for x in (F.lit(k), F.lit(v))])
    number = t.try_cast("double")
    return F.coalesce(F.try_element_at(named, F.lower(F.trim(t))), F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.lit(0.5))


def noise(t: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space; 1 for empty texts."""
    kept = F.length(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}\s]", ""))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(1.0)).otherwise(1 - kept.cast("double") / F.length(t))


def page_status(t: Column) -> Column:
    """No text under 20 characters, suspect under 200 or with more than a quarter of noise, else ok."""
    n = F.coalesce(F.length(F.trim(t)), F.lit(0))
    return F.when(n < 20, "SEM_TEXTO").when((n < 200) | (noise(t) > 0.25), "SUSPEITA").otherwise("OK")


def page_signals(t: Column) -> Column:
    """Dates, amounts and law references of a page, and its hash."""
    take = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    return F.struct(take(DATES).alias("dates"), take(AMOUNTS).alias("amounts"), take(LAWS).alias("laws"), F.sha2(t, 256).alias("page_hash"))


def verdict(t: Column) -> Column:
    """The negative token holds the positive one, so it is looked for first."""
    u = F.upper(t)
    return F.when(u.contains("IMPROCEDENTE"), "IMPROCEDENTE").when(u.contains("PROCEDENTE"), "PROCEDENTE").otherwise("INCONCLUSIVO")


def questions(t: Column) -> Column:
    """Questions between separator lines, trimmed, without empty ones."""
    parts = F.split(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"(?m)^\s*(?:---|—|___|- - -|– – –)\s*$")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def snippet(t: Column, head: int = 3000, tail: int = 1000) -> Column:
    """The head and tail of long texts."""
    return F.when(F.length(t) > head + tail, F.concat(F.substring(t, 1, head), F.lit("\n[...]\n"), F.right(t, F.lit(tail)))).otherwise(t)


def html_parts(h: Column) -> Column:
    """Title, links and text of a page."""
    links = F.regexp_extract_all(h, F.lit(r'href="([^"]*)"'), F.lit(1))
    text = F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", " "), r"\s+", " "))
    return F.struct(F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), links.alias("links"), text.alias("text"))


def title_from_name(name: Column) -> Column:
    """A file name as a title."""
    return F.initcap(F.trim(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  ")))


def byte_size(n: Column) -> Column:
    """Bytes with the largest fitting unit."""
    out = F.concat(F.format_number(n / 1024**3, 1), F.lit(" GB"))
    for power, unit in ((2, " MB"), (1, " KB"), (0, " B")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_number(n / 1024**power, 1), F.lit(unit))).otherwise(out)
    return out


def token_estimate(t: Column) -> Column:
    """A fourth of the characters."""
    return F.floor(F.length(t) / 4).cast("long")


def table_rows(t: Column) -> Column:
    """Cells of lines with a bar or tab; separator lines are left out."""
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[|\t]") & ~x.rlike(r"^[\s|:+-]*$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"[|\t]"), lambda c: F.trim(c))
    return F.transform(lines, cells)


def publication_date(t: Column) -> Column:
    """dd/mm/yyyy, else dd de month de yyyy, else the first of January of a year."""
    slashed = F.to_date(F.try_to_timestamp(F.regexp_extract(t, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("d/M/yyyy")))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(t, r"(?iu)\d{1,2} de (\w+|março) de \d{4}", 1)))
    part = lambda i: F.regexp_extract(t, r"(?iu)(\d{1,2}) de (?:\w+|março) de (\d{4})", i).try_cast("int")
    worded = F.when(month > 0, F.to_date(F.try_to_timestamp(F.concat_ws("-", part(2).cast("string"), month.cast("string"), part(1).cast("string")), F.lit("yyyy-M-d"))))
    year = F.to_date(F.try_to_timestamp(F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1), F.lit("yyyy")))
    return F.coalesce(slashed, worded, year)


def fact_date(t: Column, keywords: list[str], reach: int = 80) -> Column:
    """The least date within ``reach`` characters behind a keyword, else the least date of the text from 2000 on,
    else the least."""
    near = F.regexp_extract_all(t, F.lit(r"(?iu)(?:" + "|".join(keywords) + r").{0," + str(reach) + r"}?(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1))
    every = F.regexp_extract_all(t, F.lit(r"\d{1,2}/\d{1,2}/\d{4}"), F.lit(0))
    dates = lambda xs: F.filter(F.transform(xs, lambda x: F.to_date(F.try_to_timestamp(x, F.lit("d/M/yyyy")))), lambda x: F.year(x) >= 1980)
    late = F.filter(dates(every), lambda x: F.year(x) >= 2000)
    return F.coalesce(F.array_min(dates(near)), F.array_min(late), F.array_min(dates(every)))


def citation(t: Column) -> Column:
    """X20, X22 in part: article with letter, number and clause of a citation."""
    return F.struct(
        F.regexp_replace(F.regexp_extract(t, r"(?iu)\bart(?:igo|\.)?\s*(\d+\s*\.?[º°]?(?:-[A-Z])?)", 1), r"[.\s]", "").alias("article"),
        F.regexp_extract(t, r"(?iu)\bn\.?\s*[º°]\s*(\d+)", 1).alias("number"),
        F.regexp_extract(t, r"(?iu)\bal(?:ínea|\.)\s*([a-z]\))", 1).alias("clause"),
    )


def inject_markers(t: Column) -> Column:
    """Page markers at form feeds; texts that have markers stay."""
    pages = F.transform(F.split(t, "\f"), lambda x, i: F.concat(F.lit("[Página "), (i + 1).cast("string"), F.lit("]\n"), x))
    return F.when(t.contains("[Página "), t).otherwise(F.array_join(pages, "\n\n"))


def accept_cleaned(old: Column, new: Column) -> Column:
    """The new text if it is not empty and within half and one and a half times the old length."""
    n = F.length(new)
    return F.when((n > 0) & (n >= 0.5 * F.length(old)) & (n <= 1.5 * F.length(old)), new).otherwise(old)


def grams_of(text: Column, size: int) -> Column:
    """The distinct character grams of a text."""
    all_of = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substring(text, at, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(all_of)).otherwise(F.array().cast("array<string>"))
