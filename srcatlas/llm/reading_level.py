"""Reading level of each document (problem 10): classic readability formulas, the median of their grades, banded by raters' labels.

Syllables are counted per language by the rules that hyphenation goes by: which neighbouring vowels part, which letters are silent,
and where a suffix or a second word begins. The formulas are those made for the language.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from statistics import median

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.plans.runtime import spread

#: Labelled documents that the band limits are fitted on, at most: a bounded sample.
LABELLED = 20_000
BANDS = 4
#: Words from which a line without a closing mark is a sentence and no heading.
UNENDED = 9

#: Frequent short words that tell the languages apart (fixed values).
STOPWORDS = {
    "en": frozenset("the of and to is that it for with when this".split()),
    "de": frozenset("der die das und ist nicht eine sie den von wenn".split()),
    "fr": frozenset("le les des et est une du qui dans ce cette au il elle un".split()),
    "es": frozenset("el los las y es una del que por cuando no lo con se su cada".split()),
}
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_MARK = re.compile(r"^\s*(?:(?:[-*+>•]|///?|#+|\d+[.)])\s+)*")
_NO_PROSE = re.compile(r"^\s*(?:\||[-=*_]{3,}\s*$|==.*==\s*$|https?://\S+\s*$|<[^>]*>\s*$)")
_WORD = regex.compile(r"\p{L}+(?:[-'’]\p{L}+)*")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'»”)]*\s+")


def prose_sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence of a text's prose: no code, tables, headings, addresses or list marks. Hard-wrapped lines are joined."""
    if not text:
        return []
    text = _FENCE.sub("\n\n", text.replace("\r\n", "\n") + "\n")
    kept: list[str] = []
    rest: list[str] = []  # runs that no sentence mark ends
    run = ""
    for line in text.split("\n"):
        bare = "" if _NO_PROSE.match(line) else _MARK.sub("", line).strip()
        if not bare or line.startswith(("    ", "\t")) and not run:
            rest.append(run)
            run = ""
            continue
        run = f"{run} {bare}" if run else bare
        if run[-1] in ".!?…。！？:\"'»”)":
            kept.append(run)
            run = ""
    rest.append(run)
    sentences = [w for w in (_WORD.findall(x) for x in rest) if len(w) >= UNENDED]
    for part in kept:
        for s in _SENTENCE.split(part):
            w = _WORD.findall(s)
            if w and s.rstrip("\"'»”) ").endswith((".", "!", "?", "…", "。", "！", "？")):
                sentences.append(w)
    return sentences


def language_of(sentences: list[list[str]]) -> str:
    """The language with the most stopwords, '' if none has any."""
    seen = [w.lower() for s in sentences for w in s]
    best = max(STOPWORDS, key=lambda x: sum(w in STOPWORDS[x] for w in seen))
    return best if any(w in STOPWORDS[best] for w in seen) else ""


_SYLLABLES: dict[tuple[str, str], int] = {}
_CONSONANT = "[^aeiouyàâäéèêëîïôöûüù]"

#: English (fixed values): beginnings of a suffix or second word, before which an e is silent.
_ENDINGS = "ment|ful|less|ness|ly|some|work|ware|time|where|place|thing|line|like|man|men|land|house|side|body|one|day|ways?"
_EN_SILENT = re.compile(
    rf"(?<=[aeiouy])[^aeiouy]+(?<!{_CONSONANT}l)e(?=(?:{_ENDINGS})(?:s|ed|ing)?$)"  # move|ment, home|work
    rf"|[^aeiouytd](?<!{_CONSONANT}l)ed$|[^aeiouyscxzgl](?<![cs]h)es$|[aeiouy]les$|[^aeiouy](?<!{_CONSONANT}l)e$"
    r"|^ever(?=y)|(?<=diff)er(?=en)|(?<=int)er(?=est)|(?<=bus)i(?=ness)|(?<=v)e(?=getab)"
)
#: English (fixed values): neighbouring vowels, and consonants, that make one more syllable.
_EN_MORE = re.compile(
    r"(?<![ctg])ia(?!ge)|(?<![ctsg])(?<!ll)(?<!xi)io|(?<![ctxg])iu|ii|(?:(?<![cthr])|(?<=sc))ie(?=n[ct]|t(?:s|ed|ly)?$)|(?<!p)(?<!g)eo(?!u)|(?<=cr)ea(?=t)|(?<=^r)ea(?=c|ss)|ea(?=s?$)(?<=dea|rea)"
    r"|(?<![qg])ua(?=l|t|r[yi])|(?<![qgb])ue(?=l|n|t)|(?<![qgb])ui(?=ng|n$|d|ty|tous|tive)|oe(?=m|t|x)|uou|[aeouy]ing|[^aeiouy]ism|(?<=th)m$|[aeiou]y(?=ing)|(?<=^co)o(?=p|r)|(?<=^z)oo(?=l)"
)
_EN_LETTERS = re.compile(r"[aeiouy]+")
_DE_NUCLEUS = re.compile(r"äu|au|eau|ei|eu|ai|ay|ey|ie(?!$|n$|r[et])|aa|ee|oo|ou|[aeiouyäöüéèà]")
_ES_RUN = re.compile(r"[aeiouáéíóúüy]+")
_FR_NUCLEUS = re.compile(r"eau|œu|oeu|oui|ou(?=[aeiéèê])|ou|oi|oî|ay|ai|aî|ei|eû|eu|au|ui|(?<=[bcdfgptv][lr])i|i(?=[aeoéèê])[aeoéèê]u?|y(?=[aeoé])[aeoé]|[aeiouyàâäéèêëîïôöûüùœæ]")


def _english(w: str) -> int:
    w = re.sub(r"(?<=[aeiou])y(?=[aeiou])|^y(?=[aeiou])|(?<=q)u", "w", w)  # consonants there
    return len(_EN_LETTERS.findall(w)) - len(_EN_SILENT.findall(w)) + len(_EN_MORE.findall(w))


def _german(w: str) -> int:
    return len(_DE_NUCLEUS.findall(re.sub(r"(?<=q)u", "", w)))


def _spanish(w: str) -> int:
    """Strong and accented vowels part, weak ones lean on them."""
    w = re.sub(r"(?<=[gq])u(?=[eiéí])", "", w)
    return sum(max(1, sum(c in "aeoáéóíú" for c in run)) for run in _ES_RUN.findall(re.sub(r"y(?=[aeiouáéíóú])", "j", w)))


def _french(w: str) -> int:
    w = re.sub(r"(?<=[gq])u(?=[eiéèêy])|(?<=q)u", "", w)
    n = len(_FR_NUCLEUS.findall(w))
    return n - 1 if n > 1 and re.search(r"[^aàâoou]es?$|[éiu]es?$", w) and not re.search(r"[aàâo]es?$", w) else n


_COUNT = {"en": _english, "de": _german, "es": _spanish, "fr": _french, "": _english}


def syllables(word: str, lang: str) -> int:
    """Syllables of a word; parts with a hyphen or apostrophe count each, and there is at least one."""
    got = _SYLLABLES.get((word, lang))
    if got is None:
        parts = re.split(r"[-'’]", word.lower())
        got = max(1, sum(max(1, _COUNT[lang](p)) for p in parts if len(p) > 1 or p in "aeiouyàéáíóú"))
        if len(_SYLLABLES) > 500_000:
            _SYLLABLES.clear()
        _SYLLABLES[word, lang] = got
    return got


def grade(sentences: list[list[str]], lang: str) -> float:
    """Median of the grade estimates used for a language.

    LIX, ARI, Coleman-Liau, Flesch-Kincaid, Fog and SMOG; with them for German Amstad's reading ease, the first and fourth Vienna
    formula and G-SMOG, for French Kandel and Moles' ease. For Spanish LIX and ARI beside Fernández Huerta's and Szigriszt's
    ease, Crawford's formula and SOL. A reading ease E is the grade (120 - E) / 6. Which of the general ones stand beside a
    language's own was chosen by agreement with labels held out.
    """
    flat = [w for s in sentences for w in s]
    n, s = len(flat), len(sentences)
    counts = [syllables(w, lang) for w in flat]
    letters, hard, long = sum(map(len, flat)) / n, sum(c >= 3 for c in counts), 100 * sum(len(w) > 6 for w in flat) / n
    w, y, one, many = n / s, sum(counts) / n, 100 * sum(c == 1 for c in counts) / n, 100 * hard / n
    root = (30 * hard / s) ** 0.5
    smog, lix, ari = 1.043 * root + 3.1291, (w + long) / 4 - 3, 4.71 * letters + 0.5 * w - 21.43
    ease = lambda e: (120 - e) / 6
    if lang == "es":
        return median((lix, ari, ease(206.84 - 60 * y - 1.02 * w), ease(206.835 - 62.3 * y - w), 4.9 * y - 20.5 / w - 3.407, 0.74 * smog - 2.51))
    own = {
        "de": lambda: (ease(180 - w - 58.5 * y), 0.1935 * many + 0.1672 * w + 0.1297 * long - 0.0327 * one - 0.875, 0.2656 * w + 0.2744 * many - 1.693, root - 2),
        "fr": lambda: (ease(207 - 1.015 * w - 73.6 * y),),
    }.get(lang, tuple)()
    return median((lix, ari, 5.88 * letters - 29.6 / w - 15.8, 0.39 * w + 11.8 * y - 15.59, 0.4 * (w + many), smog, *own))


def _grades(batches: Iterator[pa.RecordBatch], limits: dict[str, list[float]] | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs, grades, bands = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sentences = prose_sentences(text)
            if sentences:
                lang = language_of(sentences)
                g = grade(sentences, lang)
                ids.append(doc_id)
                langs.append(lang)
                grades.append(g)
                bands.append(1 + bisect_right(limits.get(lang) or limits[""], g) if limits else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(grades, pa.float64()), pa.array(bands, pa.int64())], names=["doc_id", "text_lang", "grade", "band"]
        )


_SCHEMA = "doc_id bigint, text_lang string, grade double, band bigint"


def fit_limits(points: list[tuple[float, float]]) -> list[float]:
    """The BANDS - 1 ascending limits with the least sum of distances between band and label, by dynamic programming."""
    points = sorted(points)
    if not points:
        return [5.0, 10.0, 15.0][: BANDS - 1]
    values = [g for g, _ in points]
    cuts = [values[0] - 1] + [(a + b) / 2 for a, b in zip(values, values[1:])] + [values[-1] + 1]
    n = len(points)
    cost = [[0.0] * (n + 1) for _ in range(BANDS)]
    for b in range(BANDS):
        for i, (_, label) in enumerate(points):
            cost[b][i + 1] = cost[b][i] + abs(label - (b + 1))
    best = cost[0][:]
    back: list[list[int]] = []
    for b in range(1, BANDS):
        low, arg, new, args = float("inf"), 0, [], []
        for i in range(n + 1):
            if (x := best[i] - cost[b][i]) < low:
                low, arg = x, i
            new.append(low + cost[b][i])
            args.append(arg)
        best, back = new, [*back, args]
    at, chosen = n, []
    for args in reversed(back):
        at = args[at]
        chosen.append(at)
    chosen = [0, *reversed(chosen), n]
    limits = []
    for b in range(1, BANDS):  # equally good cuts, within a hundredth of the points: their middle in grades
        span = range(chosen[b - 1], chosen[b + 1] + 1)
        at_cut = {i: cost[b - 1][i] - cost[b][i] for i in span}
        good = [i for i in span if at_cut[i] <= min(at_cut.values()) + n / 100]
        limits.append((cuts[good[0]] + cuts[good[-1]]) / 2)
    return sorted(limits)


def fitted_limits(documents: DataFrame, labels: DataFrame) -> dict[str, list[float]]:
    """Band limits per language ('' for all together) from the raters' median band of at most LABELLED documents."""
    rated = labels.where(F.col("band").between(1, BANDS) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "rater", "band"]).groupBy("doc_id").agg(F.avg("band").cast("double").alias("label"))
    sample = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))  # bounded by LABELLED
    texts = documents.select("doc_id", "text").join(sample.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    got = texts.mapInArrow(_grades, _SCHEMA).join(sample, "doc_id").select("text_lang", "grade", "label").collect()
    limits = {"": fit_limits([(r["grade"], r["label"]) for r in got])}
    for lang in STOPWORDS:
        own = [(r["grade"], r["label"]) for r in got if r["text_lang"] == lang]
        if len(own) >= 25:
            limits[lang] = fit_limits(own)
    return limits


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_lang, grade, band) of each document with prose, band 1 (easiest) to BANDS.

    Documents that are null, blank or only code, tables and headings are left out. Repeated rows give repeated results. Null
    bands and raters do not count; without labels fixed limits hold. The language is told from the text, not from a column.
    """
    limits = fitted_limits(documents, labels)
    return spread(documents.select("doc_id", "text").where(F.col("text").isNotNull())).mapInArrow(partial(_grades, limits=limits), _SCHEMA)


def level_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text_lang, band, n): documents per language and band."""
    return reading_levels(documents, labels).groupBy("text_lang", "band").agg(F.count(F.lit(1)).alias("n"))
