"""Text columns: tokens, language evidence, secrets, cleaning and cutting. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{Nl}\p{No}]+"
TOKENS = r"[\p{L}\p{N}_'-]+"

# Function words and letters that count as evidence for a language.
STOPWORDS = {
    "en": "the i you to and a is it of for on with my me we in at do that this can could would please have what when how are be if or so not just about there here get want need from your while due",
    "de": "ich du wir sie er der die das den dem ein eine einen und oder aber mit von nach für auf im ist bin habe hat nicht kein möchte kann bitte danke wenn wie was wo dann noch schon mir mich sehr auch hier fahre fahren soll gerne",
    "pl": "nie się jest jestem mam masz chcę chciałbym proszę dziękuję oraz lub ale że to ten ta te dla przy po za na do z w o od jak co gdzie kiedy czy tylko jeszcze już bardzo mnie mi cię ty wy my on ona może by bym żeby",
    "fr": "je tu il elle nous vous le la les un une des du de et ou mais que qui ne pas pour avec dans sur en au aux ce cette ces mon ma mes votre vos est suis ai peut pouvez voudrais veux souhaite merci si comme très où quand y moi toi leur sa son ses ça puis ensuite bonjour à",
    "es": "el la los las un una unos unas de del y e o u pero que quién no más para por con en sin sobre al lo su sus mi mis tu tus estoy soy es son está tengo quiero necesito gracias sí como muy bien luego después dónde cuando se le les me te nos si ha hay esta este esto estos estas yo tú usted podría gustaría",
}
DIACRITICS = {"en": "", "de": "äöüß", "pl": "ąćęłńóśźż", "fr": "àâçéèêëîïôùûœ", "es": "áéíóúñü¿¡"}

# Phrases that mark a language.
PHRASES = {
    "fr": r"(?iu)\b(je (souhaite|voudrais|veux|pars|dois)|bonjour,? je|pouvez-vous|itin[ée]raire|j'ai besoin d')",
    "de": r"(?iu)\b(ich (m[öo]chte|brauche|muss|h[aä]tte)|guten (tag|morgen)|wie komme ich|kannst du mich)",
    "pl": r"(?iu)\b(proszę o|chciał(by|m)ym|dzień dobry|jak dojadę|poprosz[ęę]|szukam trasy)",
    "es": r"(?iu)\b(quiero (ir|que|saber)|podr[ií]a usted|buenos d[ií]as|hola,? quer[ií]a|necesito ir)",
    "en": r"(?iu)\b(could you|can you (tell|help|find)|i (want|need) to (get|go|drive)|good (morning|afternoon),? (i|can|could))",
}

# Secrets as written in a URL or assignment, as a JSON member, and in error texts.
_NAMES = r"(api[-_]?key|access[-_]?token|subscription[-_]?key|token|key)"
SECRET_ASSIGNED = r"(?iu)\b" + _NAMES + r"\s*=\s*([A-Za-z0-9_.\-]{8,})"
SECRET_MEMBER = r"(?iu)[\"']" + _NAMES + r"[\"']\s*:\s*[\"']([A-Za-z0-9_.\-]{8,})[\"']"
SECRET_IN_ERROR = r"(?iu)\b" + _NAMES + r"=([A-Za-z0-9_\-.]{6,})"

# Speaker names that a simulated user may put in front of a message.
SPEAKERS = r"(?iu)^\s{0,3}(?:user|driver|passenger|assistant|kierowca|u[żz]ytkownik|pasazer|nutzer|fahrer|passagier|conducteur|conductrice|passager|chauffeur|usuario|conductor|pasajero)\s*[:\-–—>]+\s*"
QUOTES = "\"'“”„«»‘’"


def language_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def language_scores(text: Column, tokens: Column) -> Column:
    """Map of language to score: share of stop words, and 0.05 for each diacritic a token. Null below six tokens.

    tokens should be a column that is there already; worked out inline it would be evaluated for each language."""
    low, n = F.lower(text), F.size(tokens)

    def score(lang: str) -> Column:
        stop = F.size(F.filter(tokens, lambda t: t.isin(STOPWORDS[lang].split())))
        marks = F.length(low) - F.length(F.translate(low, DIACRITICS[lang], "")) if DIACRITICS[lang] else F.lit(0)
        return stop / n + 0.05 * (marks / n)

    return F.when(n >= 6, F.create_map(*(x for lang in STOPWORDS for x in (F.lit(lang), score(lang)))))


def language_guess(scores: Column) -> Column:
    """The best language of a score map; of equals the first of en, de, pl, fr, es."""
    best = F.array_max(F.map_values(scores))
    return F.get(F.filter(F.array(*map(F.lit, STOPWORDS)), lambda lang: scores[lang] == best), F.lit(0))


def language_mismatch(declared: Column, scores: Column) -> Column:
    guess = language_guess(scores)
    top = scores[guess]
    return F.coalesce((guess != declared) & (top >= 0.12) & (top > scores[declared] + 0.04), F.lit(False))


def phrase_mismatch(declared: Column, text: Column) -> Column:
    """The first other language of which a marking phrase is in the text, else null."""
    return F.coalesce(*(F.when((declared != lang) & text.rlike(p), F.lit(lang)) for lang, p in PHRASES.items()))


def scrub(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET_ASSIGNED, "$1=***"), SECRET_MEMBER, "$1=***")


def secret_count(text: Column) -> Column:
    once = F.regexp_replace(text, SECRET_ASSIGNED, "$1=***")
    return F.regexp_count(text, F.lit(SECRET_ASSIGNED)) + F.regexp_count(once, F.lit(SECRET_MEMBER))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRET_IN_ERROR, "$1=***")


def clean_user_message(text: Column) -> Column:
    """Without code fences, up to three speaker names, and quotes around the whole (eight layers at most)."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    t = reduce(lambda x, _: F.regexp_replace(F.trim(x), SPEAKERS, ""), range(3), t)
    pair = rf"(?s)^[{QUOTES}](.*)[{QUOTES}]$"
    return F.trim(reduce(lambda x, _: F.trim(F.regexp_replace(x, pair, "$1")), range(8), t))


def head_tail(text: Column, cap: int) -> Column:
    """Beyond cap characters: the first 70 %, a mark with the number cut, the last 25 %."""
    head, tail = int(cap * 0.7), int(cap * 0.25)
    n = F.length(text)
    return F.when(n > cap, F.concat(F.left(text, F.lit(head)), F.lit("\n…["), (n - head - tail).cast("string"), F.lit(" chars cut]…\n"), F.right(text, F.lit(tail)))).otherwise(text)


def first_sentence(text: Column, cap: int = 110) -> Column:
    return F.left(F.substring_index(F.substring_index(text, ". ", 1), "\n", 1), F.lit(cap))


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def capped_payload(ok: Column, result: Column, error: Column, cap: int = 3500) -> Column:
    """A tool's result, or its error as an object, redacted and cut."""
    return F.left(redact(F.when(ok, result).otherwise(F.to_json(F.struct(error.alias("error"))))), F.lit(cap))


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), score.try_cast("double")))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct k-grams of a token column that is there already, joined by a blank; none below k tokens."""
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - k, F.lit(0)))
    grams = F.transform(at, lambda i: F.concat_ws(" ", *(F.get(tokens, i + j) for j in range(k))))
    return F.when(F.size(tokens) >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
