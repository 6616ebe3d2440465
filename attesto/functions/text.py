"""Text functions as Column expressions.  All run inside the JVM but those at the end, which need Unicode normal forms,
entities or hashes that the JVM side lacks; they are Arrow UDFs, and an option wherever a JVM form serves."""

from __future__ import annotations

import hashlib
import html
import unicodedata
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import CONTENT_STOP_WORDS, HEADER, STOP_WORDS
from ..shipping import ship

WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
CITATION = r"\[S([1-9][0-9]*)\]"
ANY_CITATION = r"\[S[^\]\n]*\]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once: what a lambda closes over is worked out anew for each element."""
    return F.transform(F.array(x), made)[0]


def fold(x: str | Column) -> Column:
    """Lower case with the full folding of sharp s."""
    return F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))


def squeeze(x: str | Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def tokenize(x: str | Column, exact: bool = False) -> Column:
    """Words and numbers, folded, without stop words; repetitions stay.  ``exact`` folds by NFKC and full case folding, which
    differs on compatibility characters only."""
    folded = compatible(_c(x)) if exact else fold(x)
    words = F.regexp_extract_all(F.replace(folded, F.lit("ё"), F.lit("е")), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def token_count(x: str | Column) -> Column:
    """Words and single marks."""
    return F.regexp_count(_c(x), F.lit(TOKEN))


def clean_text(x: str | Column, exact: bool = False) -> Column:
    """Without replacement and control characters other than line feeds and tabs; ``exact``: in normal form C."""
    text = F.replace(composed(_c(x)) if exact else _c(x), F.lit("�"), F.lit(" "))
    return F.btrim(F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", ""), F.lit(" \n\t"))


def normalize(x: str | Column) -> Column:
    """For comparing answers: folded, with ё as е and squeezed white space."""
    return squeeze(F.replace(fold(x), F.lit("ё"), F.lit("е")))


def without_table_markup(x: str | Column) -> Column:
    return squeeze(F.regexp_replace(normalize(x), r"[|*]+", " "))


def own_citations(x: str | Column) -> Column:
    """Distinct source names cited, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit(CITATION), F.lit(1)), lambda n: F.concat(F.lit("S"), n)))


def without_citations(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), ANY_CITATION, " ")


def strip_html(x: str | Column) -> Column:
    """Text of a page by patterns: no scripts and styles, tags as spaces."""
    body = F.regexp_replace(_c(x), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(body, r"<[^>]+>", " "))


def html_title(x: str | Column) -> Column:
    """The title element without a site's name after a bar, at most 160 characters; null where there is none."""
    title = squeeze(F.regexp_extract(_c(x), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(F.substring(F.split_part(title, F.lit(" | "), F.lit(1)), 1, 160), F.lit(""))


def without_markup(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), rf"(?i)</?(?:{'|'.join(config.HTML_TAGS)})\b[^<>]*>", " ")


def without_entities(x: str | Column, exact: bool = False) -> Column:
    """Entities as characters: the usual ones, or (``exact``) all of HTML."""
    if exact:
        return unescaped(_c(x))
    text = _c(x)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_premise(x: str | Column, exact: bool = False, unwrap: bool = False) -> Column:
    """A source's text without the chunk header and inline markup, squeezed; ``unwrap``: boxed notes as running text."""
    body = F.regexp_replace(_c(x), HEADER, "")
    return squeeze(without_entities(without_markup(unwrap_single_column(body) if unwrap else body), exact))


def unwrap_single_column(x: str | Column) -> Column:
    """Tables of one column (two lines or more, one of them a rule) as running text: their cells joined, without
    emphasis.  One pass over the lines; a block is held until a line ends it."""
    row, rule = r"^\s*\|[^|\n]*\|\s*$", r"^\s*\|\s*:?-{3,}:?\s*\|\s*$"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"))

    def closed(s: Column) -> Column:
        boxed = (F.size(s["held"]) >= 2) & F.exists(s["held"], lambda h: h.rlike(rule))
        cells = F.transform(F.filter(s["held"], lambda h: ~h.rlike(rule)), lambda h: F.trim(F.regexp_replace(h, r"^\s*\||\|\s*$", "")))
        joined = F.regexp_replace(F.array_join(F.filter(cells, lambda c: c != ""), " "), r"(\*{1,2})([^*\n]+)\1", "$2")
        return F.when(boxed, F.concat(s["out"], F.array(joined))).otherwise(F.concat(s["out"], s["held"]))

    def step(s: Column, line: Column) -> Column:
        more = F.struct(s["out"].alias("out"), F.concat(s["held"], F.array(line)).alias("held"))
        end = F.struct(F.concat(closed(s), F.array(line)).alias("out"), F.array().cast("array<string>").alias("held"))
        return F.when(line.rlike(row), more).otherwise(end)

    lines = F.aggregate(F.split(_c(x), "\n", -1), start, step, closed)
    return F.when(_c(x).rlike(r"(?m)" + rule), F.array_join(lines, "\n")).otherwise(_c(x))


def premise_header(title: str | Column, path: str | Column) -> Column:
    """``Title. Section.``; a section's name counts if it has three letters and letters make up half of it."""
    name = F.trim(F.coalesce(F.try_element_at(_c(path), F.lit(-1)), F.lit("")))
    letters = F.regexp_count(name, F.lit(r"\p{L}"))
    clear = (letters >= 3) & (2 * letters >= F.length(F.replace(name, F.lit(" "))))
    parts = [F.nullif(F.rtrim(F.trim(p), F.lit(".")), F.lit("")) for p in (F.coalesce(_c(title), F.lit("")), F.when(clear, name))]
    joined = F.concat_ws(". ", *parts)
    return F.when(joined != "", F.concat(joined, F.lit("."))).otherwise("")


def with_context(text: str | Column, context: str | Column) -> Column:
    """The text after its context, unless it begins with it already."""
    c = F.coalesce(_c(context), F.lit(""))
    return F.when((c == "") | F.startswith(_c(text), c), _c(text)).otherwise(F.concat(c, F.lit("\n"), _c(text)))


def heading_only(text: str | Column, path: str | Column) -> Column:
    """A chunk whose body is just the title of its section."""

    def plain(x: Column) -> Column:
        return squeeze(fold(F.regexp_replace(F.trim(x), r"^[\d.]+\s+", "")))

    body = F.trim(F.regexp_replace(_c(text), HEADER, ""))
    return F.coalesce((F.size(_c(path)) > 0) & (body != "") & (plain(body) == plain(F.element_at(_c(path), -1))), F.lit(False))


def citation(path: str | Column, first: str | Column, last: str | Column) -> Column:
    """``A > B, стр. 3-4``; parts that are missing are left out."""
    pages = F.when(_c(first).isNotNull(), F.concat(F.lit("стр. "), _c(first).cast("string"), F.when(_c(last) != _c(first), F.concat(F.lit("-"), _c(last).cast("string"))).otherwise("")))
    return F.concat_ws(", ", F.nullif(F.array_join(_c(path), " > "), F.lit("")), pages)


def content_words(x: str | Column) -> Column:
    """Distinct folded words that say something: three characters or a digit, no stop word."""
    words = F.regexp_extract_all(fold(without_citations(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ((F.length(w) >= 3) | w.rlike(r"\p{N}")) & ~w.isin(*CONTENT_STOP_WORDS)))


def content_overlap(claim: str | Column, source: str | Column) -> Column:
    """The share of a claim's content words that its source has; 0 where it has none."""
    words = content_words(claim)
    there = F.array_distinct(F.regexp_extract_all(fold(source), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, there)).cast("double"), F.size(words)), F.lit(0.0))


def ungroup(x: str | Column) -> Column:
    """Numbers without group separators.  A separator goes if it stands after a first group and before three digits,
    with only groups between."""
    step = r"((?<![\d.,])\d{1,3}(?:\d{3})*|\G\d{3})[ ,  ](?=\d{3}(?:[ ,  ]\d{3})*(?!\d))"
    return F.regexp_replace(_c(x), step, "$1")


def claim_anchors(x: str | Column, enhancements: bool = False) -> Column:
    """Numbers, literals and identifiers that a source must hold, sorted; designators of documents are left out.
    ``enhancements``: a control with the number of its enhancement is one identifier."""
    text = F.regexp_replace(without_citations(x), config.DESIGNATOR, " ")
    found = F.array().cast("array<string>")
    if enhancements:
        found = F.transform(F.regexp_extract_all(text, F.lit(config.ANCHOR_ENHANCEMENT), F.lit(0)), lambda a: fold(F.replace(a, F.lit(" "))))
        text = F.regexp_replace(text, config.ANCHOR_ENHANCEMENT, " ")
    plain = F.transform(F.regexp_extract_all(text, F.lit(config.ANCHOR), F.lit(0)), lambda a: F.rtrim(fold(ungroup(a)), F.lit(".,")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(found, plain), lambda a: a != "")))


def is_identifier(a: Column) -> Column:
    return a.rlike(r"\p{L}") & a.rlike(r"\p{N}") & ~a.rlike(r"^(?:0x[0-9a-f]+|0b[01]+)$") & ~a.startswith("--") & ~a.rlike("[_=/+]")


def anchors_found(anchors: str | Column, text: str | Column) -> Column:
    """The anchors that stand in the text: numbers alone, others anywhere."""
    def there(hay: Column, a: Column) -> Column:
        alone = F.rlike(hay, F.concat(F.lit(r"(?<![\p{L}\p{N}_.])"), F.replace(a, F.lit("."), F.lit("\\.")), F.lit(r"(?![\p{L}\p{N}_])")))
        return F.when(a.rlike(r"^[0-9.]*[0-9][0-9.]*$"), alone).otherwise(F.contains(hay, a))

    both = F.struct(fold(ungroup(text)).alias("hay"), _c(anchors).alias("anchors"))
    return bound(both, lambda x: F.filter(x["anchors"], lambda a: there(x["hay"], a)))


def anchors_present(anchors: str | Column, text: str | Column) -> Column:
    """Whether all anchors stand in the text."""
    return F.size(anchors_found(anchors, text)) == F.size(_c(anchors))


def code_span(claim: str | Column, premise: str | Column, least: int = 12) -> Column:
    """Whether a literal of the claim (ASCII, an operator, two words) stands in the premise, blanks at operators aside.
    What follows a label with a colon is tried by itself, too."""
    tight, operator = ("[" + "".join(f"\\{c}" for c in chars) + "]" for chars in (config.CODE_TIGHT, config.CODE_OPERATORS))

    def quoted(x: str | Column) -> Column:
        marks = config.QUOTE_MARKS
        kept = [m for m in marks if marks[m]]
        return F.translate(_c(x), "".join(kept) + "".join(m for m in marks if not marks[m]), "".join(marks[m] for m in kept))

    def canonical(x: Column) -> Column:
        return F.regexp_replace(x, rf"\s*({tight})\s*", "$1")

    hay = canonical(squeeze(quoted(premise)))
    runs = F.transform(F.regexp_extract_all(quoted(claim), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0)), lambda r: F.split(squeeze(r), r"(?<=:)\s"))
    ends = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.size(r)), lambda k: F.array_join(F.slice(r, k, F.size(r)), " "))))
    literals = F.filter(F.transform(ends, lambda e: F.btrim(e, F.lit(" .,;:"))), lambda e: (F.length(e) >= least) & e.rlike(operator) & F.contains(e, F.lit(" ")))
    both = F.struct(hay.alias("hay"), literals.alias("literals"))
    return bound(both, lambda x: F.exists(x["literals"], lambda e: F.contains(x["hay"], canonical(e))))


def is_absence(x: str | Column) -> Column:
    """A statement that sources lack information."""
    return _c(x).rlike(config.ABSENCE)


def is_verdict(x: str | Column) -> Column:
    """A bare verdict that only introduces the next claim."""
    words = F.regexp_count(F.regexp_replace(_c(x), ANY_CITATION, ""), F.lit(r"[\p{L}\p{N}_]+"))
    return F.trim(_c(x)).rlike(config.VERDICT) & (words <= 3)


def has_negation(x: str | Column) -> Column:
    return _c(x).rlike(config.NEGATION)


def strip_verdict(x: str | Column, least: int = 4) -> Column:
    """Without a leading "No," if that many words follow."""
    rest = F.regexp_replace(_c(x), config.VERDICT_PREFIX, "")
    cut = (rest != _c(x)) & (F.regexp_count(rest, F.lit(r"[\p{L}\p{N}_]+")) >= least)
    return F.when(cut, F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30))).otherwise(_c(x))


def normalize_keywords(x: str | Column) -> Column:
    """Requirement keywords of standards in lower case."""
    lowered = reduce(lambda t, w: F.regexp_replace(t, rf"\b{w}\b", w.lower()), config.KEYWORDS, _c(x))
    return F.when(_c(x).rlike(rf"\b(?:{'|'.join(config.KEYWORDS)})\b"), lowered).otherwise(_c(x))  # most texts have none


def text_script(x: str | Column) -> Column:
    """ru or en by the number of letters, ru on ties; null without letters."""
    low = F.lower(_c(x))
    ru, en = F.regexp_count(low, F.lit("[а-яё]")), F.regexp_count(low, F.lit("[a-z]"))
    return F.when(ru + en > 0, F.when(ru >= en, "ru").otherwise("en"))


def question_problem(x: str | Column, most: int = 4000, exact: bool = False) -> Column:
    """Why a question is rejected, or null; ``exact`` looks at its compatibility form."""
    text = F.trim(compatible(_c(x), fold=False) if exact else _c(x))
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.length(text) > most, "too_long")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control_characters")
        .when(text.rlike(r"(?i)(ignore|disregard)\s+(all\s+)?(previous|prior)\s+instructions|system\s+prompt"), "prompt_injection")
    )


def contains_fact(text: str | Column, fact: str | Column) -> Column:
    """Any alternative of ``a|b`` occurs, normalised; ``re:`` introduces a pattern."""
    plain = F.exists(F.split(_c(fact), r"\|"), lambda a: F.contains(normalize(text), normalize(a)))
    return F.when(F.startswith(_c(fact), F.lit("re:")), F.rlike(normalize(text), F.substring(_c(fact), 4, 1 << 30))).otherwise(plain)


def parse_rewrite(reply: str | Column, question: str | Column) -> Column:
    """The first line of a reply without quotes, unless it is far longer than the question."""
    lines = F.filter(F.transform(F.split(_c(reply), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.btrim(F.try_element_at(lines, F.lit(1)), F.lit("«»\"' "))
    return F.when((line != "") & (F.length(line) <= 3 * F.length(_c(question)) + 40), line)


def stable_id(*parts: str | Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", *(_c(p).cast("string") for p in parts))), 1, 16)


def sentences(x: str | Column) -> Column:
    """Split after stop marks before white space."""
    return F.filter(F.split(_c(x), r"(?<=[.!?。！？])\s+"), lambda s: s != "")


def sentence_windows(s: Column, most: int = 2) -> Column:
    """Distinct runs of 1 to ``most`` neighbouring sentences, except the whole."""
    def of(s: Column, size: int) -> Column:
        n = F.size(s) - (size - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(s, i, size), " "))).otherwise(F.array().cast("array<string>"))

    def runs(s: Column) -> Column:
        all_ = F.array_distinct(F.concat(*(of(s, k) for k in range(1, most + 1))))
        return bound(F.array_join(s, " "), lambda whole: F.filter(all_, lambda w: w != whole))

    return F.when(s.isNotNull(), bound(s, runs))


def table_cells(row: str | Column) -> Column:
    """The cells of a line of a pipe table."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(_c(row)), r"^\|+", ""), r"\|+$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))


def slug(x: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def mixed_script(x: str | Column) -> Column:
    """Words that mix Latin and Cyrillic letters."""
    words = F.regexp_extract_all(_c(x), F.lit(r"[\p{L}]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("(?iu)[a-z]") & w.rlike("(?iu)[а-яё]"))


def ends_inside_sentence(x: str | Column) -> Column:
    return ~F.rtrim(_c(x)).rlike(r"[.!?。！？:;»\"”)\]]$")


def number_swap(x: str | Column) -> Column:
    """The first free-standing number of at most six digits raised by 1, years by 3; null without one."""
    pattern = r"(?s)^(.*?(?<![\p{L}\p{N}_.,]))([0-9]{1,6})(?![0-9])(.*)$"
    body = F.regexp_replace(_c(x), r"\s*(\[S\d+\])+\s*\.?\s*$", "")
    n = F.nullif(F.regexp_extract(body, pattern, 2), F.lit("")).cast("long")
    new = F.when(n.between(1000, 2100), n + 3).otherwise(n + 1)
    return F.when(n.isNotNull(), F.concat(F.regexp_extract(_c(x), pattern, 1), new.cast("string"), F.regexp_extract(_c(x), pattern, 3)))


def evidence_windows(sentences_: Column) -> Column:
    """Sentences, with the one before where a sentence begins by referring back, and with the one after where that does;
    distinct, in order."""
    n = F.size(sentences_)
    back = F.transform(sentences_, lambda s: s.rlike(config.ANAPHORA))
    one = lambda i: F.array_join(F.slice(sentences_, F.when((i > 1) & back[i - 1], i - 1).otherwise(i), F.when((i > 1) & back[i - 1], 2).otherwise(1) + F.when((i < n) & F.coalesce(F.get(back, i), F.lit(False)), 1).otherwise(0)), " ")
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one))).otherwise(F.array().cast("array<string>"))


def safe_filename(x: str | Column, most: int = 100) -> Column:
    """A name without folders, control characters and what file systems reserve; null if nothing is left."""
    name = F.regexp_extract(F.replace(_c(x), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    kept = F.btrim(F.regexp_replace(F.regexp_replace(name, r"[\p{Cc}<>:\"|?*]", "_"), r"\s+", " "), F.lit(" ."))
    return F.nullif(F.substring(kept, 1, most), F.lit(""))


def sentence_at(x: str | Column, offset: str | Column) -> Column:
    """The sentence that holds the character at an offset (from 0); null beyond the text."""
    parts = F.regexp_extract_all(_c(x), F.lit(r"(?s).+?(?:[.!?。！？]+(?:\s+|$)|$)"), F.lit(0))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.length(F.array_join(F.slice(parts, 1, k), "")))
    k = F.array_position(F.transform(ends, lambda e: e > _c(offset)), True)
    return F.when((k > 0) & (_c(offset) >= 0), F.trim(F.try_element_at(parts, k.cast("int"))))


def ru_stem(x: str | Column) -> Column:
    """A lower-case Russian word without its longest ending that leaves three letters; other words as they are."""
    w = _c(x)
    cut = lambda e: F.when(F.endswith(w, F.lit(e)) & (F.length(w) >= len(e) + 3), F.left(w, F.length(w) - len(e)))
    return F.when(w.rlike("^[а-яё]+$"), F.coalesce(*map(cut, sorted(config.RU_ENDINGS, key=len, reverse=True)), w)).otherwise(w)


def word_pattern(x: str | Column) -> Column:
    """A pattern for a word of an answer in other forms: numbers stand alone, number words also as digits and in any case,
    others by the beginning that inflection leaves."""
    w = _c(x)
    n = F.length(w)
    keep = F.when(n >= 5, F.greatest(F.lit(4), F.ceil(n * 3 / 5).cast("int"))).otherwise(F.greatest(F.lit(3), n - 1))
    begins = lambda p: F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), p, F.lit(r"[\p{L}\p{N}_]*"))
    out = begins(F.left(w, F.least(keep, F.length(ru_stem(w)))))
    for digit, forms in config.NUMERALS.items():
        alone = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(forms.split())})(?![\p{{L}}\p{{N}}_])|(?<!\p{{N}}){digit}(?!\p{{N}})"
        out = F.when(w.isin(*forms.split()), F.concat(F.lit("(?:"), begins(F.left(w, F.lit(4))), F.lit(f"|{alone})"))).otherwise(out)
    return F.when(w.rlike(r"\p{N}"), F.concat(F.lit(r"(?<!\p{N})"), w, F.lit(r"(?!\p{N})"))).otherwise(out)


def answer_pattern(x: str | Column) -> Column:
    """A pattern that a text matches if it has the words of an answer in any order and form: its numbers and its longest
    other words, four in all; short words count only if there are no others."""
    words = F.regexp_extract_all(normalize(F.regexp_replace(_c(x), r"\[[^\]]*\]", " ")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) > 3) | w.rlike(r"\p{N}"))
    some = F.when(F.size(telling) > 0, telling).otherwise(words)
    numbers = F.filter(some, lambda w: w.rlike(r"\p{N}"))
    others = F.filter(some, lambda w: ~w.rlike(r"\p{N}"))
    ranked = F.transform(F.array_sort(F.transform(others, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda s: s["w"])
    chosen = F.array_distinct(F.concat(numbers, F.slice(ranked, 1, F.greatest(F.lit(0), 4 - F.size(numbers)))))
    return F.concat(F.lit("(?s)"), F.array_join(F.transform(chosen, lambda w: F.concat(F.lit("(?=.*"), word_pattern(w), F.lit(")"))), ""))


def sub_questions(x: str | Column) -> Column:
    """The parts of a question that asks several things: split before a coordinated question word; one part otherwise."""
    asks = r"what|which|who|whom|whose|when|where|why|how|что|кто|где|когда|почему|зачем|сколько|какой|какая|какое|какие|каков|как"
    parts = F.split(_c(x), rf"(?iu)(?:[,;]\s*|\s+)(?:and|и|а также)\s+(?=(?:in|at|to|for|by|в|на|к|с|по|для)?\s*(?:{asks})(?![\p{{L}}]))|(?<=\?)\s+(?=\S)")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def asks_several(x: str | Column) -> Column:
    """Whether the form of a question says that it has several parts."""
    return _c(x).rlike(config.SEVERAL_PARTS)


def same_question(a: str | Column, b: str | Column) -> Column:
    """Whether two questions are the same words in the same order."""
    words = lambda c: F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return words(a) == words(b)


def display_text(x: str | Column) -> Column:
    """Without control and format characters other than line feeds and tabs."""
    return F.regexp_replace(_c(x), r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def chunk_body(x: str | Column) -> Column:
    """A chunk's text without its header."""
    return F.trim(F.regexp_replace(_c(x), HEADER, ""))


def distinct_values(a: str | Column, b: str | Column) -> Column:
    """Whether neither of two values holds the other."""
    x, y = normalize(a), normalize(b)
    return (x != "") & (y != "") & ~F.contains(x, y) & ~F.contains(y, x)


# Arrow UDFs.


def _each(kind: str, f) -> object:
    """An Arrow function of single values."""
    def run(x: pd.Series) -> pd.Series:
        known: dict = {}  # equal values of a batch are worked out once
        return x.map(lambda v: None if v is None else known[v] if v in known else known.setdefault(v, f(v)))

    ship(SparkSession.active())
    return F.pandas_udf(run, kind)


def _ascii(x: Column) -> Column:
    """Whether a text is ASCII: then normal forms leave it as it is, and it needn't leave the JVM."""
    return x.rlike(r"^\p{ASCII}*$")


def compatible(x: Column, fold: bool = True) -> Column:
    """Compatibility form (NFKC), with full case folding."""
    f = _each("string", lambda v: unicodedata.normalize("NFKC", v).casefold() if fold else unicodedata.normalize("NFKC", v))
    return F.coalesce(f(F.when(~_ascii(x), x)), F.lower(x) if fold else x)


def composed(x: Column) -> Column:
    """Normal form C."""
    return F.coalesce(_each("string", lambda v: unicodedata.normalize("NFC", v))(F.when(~_ascii(x), x)), x)


def unescaped(x: Column) -> Column:
    """All entities of HTML as characters."""
    return F.coalesce(_each("string", html.unescape)(F.when(F.contains(x, F.lit("&")), x)), x)


def blake2b_slot(x: str | Column, slots: int) -> Column:
    """The slot of a term: its 64-bit BLAKE2b as a big-endian number, modulo the slots."""
    return _each("long", lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") % slots)(_c(x))


def url_uuid(x: str | Column) -> Column:
    """The version 5 UUID of a name in the URL namespace."""
    return _each("string", lambda v: str(uuid.uuid5(uuid.NAMESPACE_URL, v)))(_c(x))
