"""Broken prompt and response pairs (problem 5): dictionary compression, word dictionaries and terminal contexts."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutario.session import cut
from minutario.versions import latest

#: Words that stand for no value.
NO_VALUE = [
    "null", "none", "nil", "nan", "na", "n a", "s d", "n d", "nd", "undefined", "empty", "blank", "missing", "vacio",
    "vacia", "ninguno", "ninguna", "nada", "nulo", "sin valor", "sin respuesta", "sin datos", "no disponible",
    "not available", "not applicable", "no answer", "no response", "no aplica", "no value",
]

#: The refusal dictionary in English and Spanish, without accents. A sentence declines if a speaker's
#: inability meets an act of speech, a source's denial an act of telling, or a denial a word for what is missing.
SPEAKER = {"en": "i we", "es": ""}
INABILITY = {
    "en": "cannot|can not|can t|could not|couldn t|unable|not able|won t|will not|would not|do not|don t|must decline|have to decline|decline|abstain|refuse|rather not|prefer not|not permitted|not allowed",
    "es": "no puedo|no podemos|no puede|no es posible|no cabe|no sabria|no sabemos|no logro|no consigo|prefiero no|preferimos no|preferiria no|debo declinar|tengo que declinar|me abstengo|no se puede|no tengo permitido",
}
SPEECH = {
    "en": "answer reply respond help assist comment say tell know speculate share provide determine discuss disclose confirm find give",
    "es": "responder contestar ayudar opinar decir determinar saber dar ofrecer comentar especular confirmar",
}
SOURCE = {
    "en": "context base material transcript document documents text source sources passage passages record records minutes concept concepts excerpt excerpts information",
    "es": "contexto base material transcripcion documento documentos texto fuente fuentes pasaje pasajes acta concepto conceptos fragmento fragmentos informacion",
}
DENIAL = {"en": "not nothing none no never neither t", "es": "no nada ningun ninguno ninguna nunca ni tampoco"}
TELLING = {
    "en": "say says state states mention mentions contain contains answer answers settle settles tell tells include includes specify specifies cover covers address addresses provide provides support supports indicate indicates resolve resolves",
    "es": "contiene contienen dice dicen menciona mencionan ofrece ofrecen incluye incluyen indica indican aclara aclaran permite permiten recoge recogen responde responden responda contesta contestan resuelve resuelven",
}
MISSING = {"en": "answer reply response information data evidence mention", "es": "respuesta informacion datos evidencia mencion"}
SHORTAGE = {"en": "insufficient|not enough|not sufficient|lacking|missing", "es": "insuficiente|insuficientes|no basta|no es suficiente|falta"}
MACHINE = r"\bas an? (?:ai|language model|large language model|assistant)\b|\bcomo (?:modelo de lenguaje|asistente|ia|inteligencia artificial)\b"


def _either(words: str) -> str:
    return "(?:" + "|".join(words.split("|") if "|" in words else words.split()) + ")"


def _refusal_pattern() -> str:
    few, some, more = r"(?: \w+){0,2}", r"(?: \w+){0,4}", r"(?: \w+){0,8}"
    parts = [MACHINE]
    for code in ("en", "es"):
        speaker = rf"\b{_either(SPEAKER[code])}{few} " if SPEAKER[code] else r"\b"
        parts += [
            rf"{speaker}(?:am |are |m |re )?{_either(INABILITY[code])}{some} {_either(SPEECH[code])}\b",
            rf"\b{_either(SOURCE[code])}{more} {_either(DENIAL[code])}{some} {_either(TELLING[code])}\b",
            rf"\b{_either(DENIAL[code])}(?: de)?(?: los| las| the| of the)? {_either(SOURCE[code])}{more} {_either(TELLING[code])}\b",
            rf"\b(?:{_either(DENIAL[code])}|sin|without)(?: \w+){{0,2}} {_either(MISSING[code])}\b",
            rf"\b(?:{_either(SOURCE[code])}|{_either(MISSING[code])}){some} (?:{SHORTAGE[code]})\b|\b(?:{SHORTAGE[code]}) (?:\w+ )?{_either(MISSING[code])}\b",
        ]
    parts += [r"\bi (?:really |honestly )?(?:do not|don t) know\b", r"^(?:no (?:lo )?se|lo desconozco|lo ignoro)\b(?: *$| que| si)"]
    return "|".join(f"(?:{p})" for p in parts)


_REFUSAL = re.compile(_refusal_pattern())
#: Every way of the dictionary to decline has one of these words: a sentence without any is not searched.
_SIGNS = set(f"{DENIAL['en']} {DENIAL['es']} cannot t unable decline abstain refuse prefiero preferimos preferiria declinar abstengo sin without insufficient lacking missing insuficiente insuficientes falta ai model modelo assistant asistente ia inteligencia desconozco ignoro".split())
#: A shape of whole answers is a refusal where declining is right so much more often than answers are there, the lower
#: end of its share's interval of SHAPE_Z standard errors taken.
SHAPE_LIFT, SHAPE_Z = 2.0, 4.0

#: Function words by language; words that languages share count for each. They only start the learning.
FUNCTION_WORDS = {
    "en": "the of to and a an in is was were are be been that this these it its for on with as by at from or but not than which who what why how when where has have had will would could should they their there his her because although",
    "es": "el la los las de del que y e en un una unos unas se por para con no su sus lo al como más pero es fue son era ser ha han está qué quién cuál cuándo dónde cómo según sobre entre sin hay muy ya también porque aunque",
    "fr": "le la les l de des du d que qui et en un une est était sont être a ont pour dans par sur au aux avec ne pas plus ce cette ces il elle on nous vous ils sans ou où mais parce selon après avant",
    "de": "der die das den dem des und ist war sind ein eine einen einem einer von zu mit auf für nicht im am in bei nach aus dass sich wird werden hat haben es er sie wir als auch aber oder wenn weil über unter",
    "it": "il lo la i gli le di del della dei delle che e è in un una uno si per con non su da dal dalla al alla nel nella sono era ha hanno come più ma anche questo questa perché dopo prima",
    "pt": "o a os as de do da dos das que e é em no na nos nas um uma se por pelo pela para com não foi são ser há mais mas como ao à seu sua porque quando também até já entre",
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: A text teaches its language from so many of its function words, more than of any other. An answer is judged from so
#: many words, and is in another language from so many nats of log odds.
TEACHING, SENTENCE, ODDS = 3, 5, 4.0

#: Words that only label a question or an answer.
LABELS = set("q a p r question answer the is response reply respuesta pregunta la es prompt original the".split())
#: Bytes that a copy may need beside the prompt above what the prompt needs beside itself, and the share of the prompt
#: that may stay unsaid.
COPY_BYTES, COPY_UNSAID = 1, 0.3
#: Chance of a text's end in a terminal context below which an answer counts as cut off, and the weight of the context's class
#: against its word.
TERMINAL, CLASS_WEIGHT = 0.01, 5.0

_TOKEN = re.compile(r"…|\.{2,}|\d+(?:[.,:]\d+)*|[^\W_]+|[%€$£]|[^\w\s]|_|\n")
_SOURCES = re.compile(r"(?:\s*\[\d+(?:\s*[,;]\s*\d+)*\])+\s*$")
_LIST_LINE = re.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+\S")
_CLOSERS = set("\"'”’»)]}")


def plain_words(text: str) -> list[str]:
    """Words of the text in lower case without accents."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", bare)


def is_empty(answer: str | None) -> bool:
    return answer is None or (words := " ".join(plain_words(answer))) == "" or words in NO_VALUE


def is_refusal(answer: str) -> bool:
    """Some sentence declines by the refusal dictionary."""
    sentences = (plain_words(s) for s in re.split(r"[.!?]+(?:\s|$)", answer))
    return any(not _SIGNS.isdisjoint(words) and _REFUSAL.search(" ".join(words)) is not None for words in sentences)


def answer_shape(answer: str) -> str:
    """The answer with names and numbers masked: words with a capital inside a sentence, and those with digits."""
    out, start = [], True
    for token in _TOKEN.findall(answer):
        if token[0].isalnum():
            out.append("@" if any(c.isdigit() for c in token) or (not start and token[0].isupper() and not token.isupper()) else token.lower())
            start = False
        else:
            start = token in ".!?…¿¡:\n"
    return " ".join(out)


def compressed(data: str, dictionary: str | None = None) -> int:
    """Bytes of a zstandard frame of data, beside a raw dictionary if one is given."""
    if dictionary is None:
        return len(zstandard.ZstdCompressor(level=19, write_content_size=False).compress(data.encode()))
    given = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=19, dict_data=given, write_content_size=False, write_dict_id=False).compress(data.encode()))


def is_copy(answer: str, prompt: str) -> bool:
    """The answer says nothing beside the prompt and leaves little of it unsaid, both measured by compression.

    Words in plain form without labels around. Beside the prompt, repeated to the answer's length, the answer may need
    no more than COPY_BYTES above what that repeated prompt needs; the prompt beside the answer needs no more than
    COPY_UNSAID of what it needs alone, above what it needs beside itself.
    """
    said, asked = plain_words(answer), " ".join(plain_words(prompt))
    while said and said[0] in LABELS and not asked.startswith(" ".join(said[:3])):
        said = said[1:]
    while said and said[-1] in LABELS and not asked.endswith(said[-1]):
        said = said[:-1]
    text = " ".join(said)
    if not text or not asked or sum(w not in asked for w in set(said)) > COPY_BYTES:  # each such word needs a byte at least
        return False
    beside = " ".join([asked] * (len(text) // len(asked) + 1))
    if compressed(text, beside) > compressed(beside[: len(text)], beside) + COPY_BYTES:
        return False
    return compressed(asked, text) - compressed(asked, asked) <= COPY_UNSAID * compressed(asked)


def is_list(answer: str) -> bool:
    lines = [line for line in answer.splitlines() if line.strip()]
    return len(lines) > 1 and all(map(_LIST_LINE.match, lines))


def contexts(text: str) -> Iterator[tuple[str, str, int, bool]]:
    """(class, word, run, at the end) after each token: the terminal contexts of a text.

    class is word, close, ellipsis or mark, word the last plain word, run the words since the last closing mark, colon
    or line end, up to four, and four more in a sentence that follows another one, but for a question. Quotes and brackets that close belong to the token before them; source numbers in brackets
    at the end don't count.
    """
    tokens = _TOKEN.findall(_SOURCES.sub("", text.strip()))
    word, run, kind, later, ended = "", 0, "mark", 0, ""
    for n, token in enumerate(tokens):
        if token[0].isalnum() or token in "%€$£":
            if kind in ("close", "ellipsis"):
                run, later = 0, 0 if ended == "?" else 4
            kind, word, run = "word", token.lower() if token[0].isalpha() else "0", min(run + 1, 4)
        elif token in ("…", "..", "...") or token.startswith(".."):
            kind = "ellipsis"
        elif token in ".!?":
            kind, ended = "close", token
        elif token in _CLOSERS and kind != "mark":
            pass
        elif token in ":\n":
            run, kind = 0, "mark"
        else:
            kind = "mark"
        if n + 1 == len(tokens) or tokens[n + 1] not in _CLOSERS:
            yield kind, word, run + later, n + 1 == len(tokens)


def last_context(text: str) -> tuple[str, str, int]:
    last = ("mark", "", 0)
    for kind, word, run, _ in contexts(text):
        last = (kind, word, run)
    return last


def terminal_counts(texts: DataFrame) -> DataFrame:
    """(kind, word, run, ends, n) over all complete texts (one column: text); word is null in the counts of a class."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, ends = Counter(), Counter()
            for text in batch["text"]:
                for kind, word, run, end in contexts(text):
                    for key in ((kind, None, run), (kind, word, run)):
                        n[key] += 1
                        ends[key] += end
            yield pd.DataFrame([(*key, ends[key], count) for key, count in n.items()], columns=["kind", "word", "run", "ends", "n"])

    each = texts.where("text is not null").select("text").mapInPandas(counted, "kind string, word string, run int, ends long, n long")
    return each.groupBy("kind", "word", "run").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))


def _language_words(text: Column) -> Column:
    """Distinct words of a text in lower case, without those in quotes and without names: capitals inside the text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\"[^\"]*\"|“[^”]*”|«[^»]*»|‘[^’]*’|`[^`]*`", " ")
    words = F.regexp_extract_all(bare, F.lit(r"\p{L}+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w, n: (n == 0) | (w == F.lower(w)) | (w == F.upper(w))), lambda w: F.lower(w)))


def _seed_languages(texts: DataFrame) -> DataFrame:
    """(words, lang): the place of the language with most function words in words, TEACHING at least and more than any other."""

    def among(own: list[str]) -> Column:
        return F.size(F.filter("words", lambda w: w.isin(own)))

    scores = [among(sorted(set(own.split()))) for own in FUNCTION_WORDS.values()]
    scored = texts.where(F.size("words") >= TEACHING).select("words", F.array(*scores).alias("scores")).withColumn("best", F.array_max("scores"))
    told = scored.where((F.col("best") >= TEACHING) & (F.size(F.array_remove("scores", F.col("best"))) == len(LANGUAGES) - 1))
    return told.select("words", (F.array_position("scores", F.col("best")) - 1).cast("int").alias("lang"))


def language_dictionaries(texts: DataFrame) -> DataFrame:
    """(word, weights): log probabilities of a word in each language, learnt over all texts whose function words tell it.

    texts: words, an array. A word that a language's texts lack gets that language's floor.
    """
    each = _seed_languages(texts).select("lang", F.explode("words").alias("word"))
    per = [F.sum((F.col("lang") == n).cast("long")) for n in range(len(LANGUAGES))]
    counts = each.groupBy("word").agg(F.array(*per).alias("counts"))
    totals = counts.agg(F.array(*[F.sum(F.col("counts")[n]) for n in range(len(LANGUAGES))]).alias("totals"), F.count("*").alias("words"))
    both = counts.crossJoin(F.broadcast(totals))  # one row
    # A language that hardly any text is in has no say: its floor is that of the rarest word of the largest language.
    weight = lambda c, n: F.log((c + 0.5) / (F.greatest(F.col("totals")[n], F.lit(0)) + 0.5 * F.col("words")))
    return both.select("word", F.transform("counts", weight).alias("weights"))


def spoken(texts: DataFrame, dictionaries: DataFrame, key: str) -> DataFrame:
    """(key, lang, odds): the language under which the words are most likely, and the array of all log likelihoods."""
    each = texts.select(key, F.explode("words").alias("word")).join(dictionaries, "word")
    sums = [F.sum(F.col("weights")[n]).alias(f"w{n}") for n in range(len(LANGUAGES))]
    scored = each.groupBy(key).agg(*sums, F.count("*").alias("known"))
    odds = F.array(*[F.col(f"w{n}") for n in range(len(LANGUAGES))])
    return scored.select(key, odds.alias("odds"), (F.array_position(odds, F.array_max(odds)) - 1).alias("lang"), "known")


def defective_answers(reviews: DataFrame) -> DataFrame:
    """(pregunta_id, defect) for each held review whose answer is broken; one defect each, sound answers don't come out.

    The order is empty, refusal, copy, truncated, language; a refusal where declining is right (stratum E4) is sound.
    Empty, copy and the refusal dictionary look at a row alone. Learnt over the whole table: which shapes of answers are
    given where declining is right (refusal); how often complete texts, the references, end in a context of mark or word and
    run length (truncated); and the words of each language, from the function words of all prompts, references and
    answers (language). All counts are sums joined by shape, context or word; nothing is gathered in the driver. A null
    prompt has no words and no language; repeated rows count once; empty tables give no rows.
    """
    columns = ["pregunta_id", "stratum", "pregunta", "respuesta_referencia", "respuesta_c2"]
    held = cut(latest(reviews.select(*columns, "ingested_at"), "pregunta_id", columns))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, stratum, prompt, answer in zip(batch["pregunta_id"], batch["stratum"], batch["pregunta"], batch["respuesta_c2"]):
                right = (stratum or "").startswith("E4")
                if is_empty(answer):
                    rows.append((key, right, "empty", None, False, None, None, None))
                    continue
                seen = "refusal" if is_refusal(answer) else "copy" if is_copy(answer, prompt or "") else None
                shape = xxhash.xxh64_intdigest(answer_shape(answer)) - (1 << 63)
                rows.append((key, right, seen, shape, is_list(answer), *last_context(answer)))
            yield pd.DataFrame(rows, columns=["pregunta_id", "right", "seen", "shape", "listed", "kind", "word", "run"])

    looked = held.select("pregunta_id", "stratum", "pregunta", "respuesta_c2").mapInPandas(
        look, "pregunta_id string, right boolean, seen string, shape long, listed boolean, kind string, word string, run int"
    )
    looked = cut(looked)

    total = looked.where("shape is not null").agg(F.avg(F.col("right").cast("double")).alias("base"))
    shapes = looked.where("shape is not null").groupBy("shape").agg(F.count("*").alias("n"), F.avg(F.col("right").cast("double")).alias("share"))
    n, share, z2 = F.col("n"), F.col("share"), SHAPE_Z**2  # the lower end of the share's Wilson interval
    least = (share + z2 / (2 * n) - SHAPE_Z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    shapes = shapes.crossJoin(F.broadcast(total)).where((share > 0) & (least >= SHAPE_LIFT * F.col("base"))).select("shape", F.lit(True).alias("declining"))

    ends = cut(terminal_counts(held.select(F.col("respuesta_referencia").alias("text"))))
    classes = ends.where("word is null").select("kind", "run", F.col("ends").alias("class_ends"), F.col("n").alias("class_n"))  # at most 4 kinds by 9 runs
    words = ends.where("word is not null")
    # Where no complete text has been seen the definitions hold: closed texts and bare answers of three words are whole.
    prior = F.when((F.col("kind") == "close") | ((F.col("kind") == "word") & (F.col("run") <= 3)), 1.0).otherwise(0.0)
    of_class = (F.coalesce("class_ends", F.lit(0)) + prior) / (F.coalesce("class_n", F.lit(0)) + 1)
    chance = (F.coalesce("ends", F.lit(0)) + CLASS_WEIGHT * of_class) / (F.coalesce("n", F.lit(0)) + CLASS_WEIGHT)

    parts = cut(held.select("pregunta_id", *[_language_words(F.col(c)).alias(c) for c in columns[2:]]))
    dictionaries = cut(language_dictionaries(parts.select(F.explode(F.array(*columns[2:])).alias("words"))))
    asked = spoken(parts.select("pregunta_id", F.col("pregunta").alias("words")), dictionaries, "pregunta_id").select("pregunta_id", F.col("lang").alias("asked"))
    long = parts.where(F.size("respuesta_c2") >= SENTENCE).select("pregunta_id", F.col("respuesta_c2").alias("words"))
    said = spoken(long, dictionaries, "pregunta_id").join(asked, "pregunta_id")
    other = said.where((F.col("lang") != F.col("asked")) & (F.col("odds")[F.col("lang").cast("int")] - F.col("odds")[F.col("asked").cast("int")] >= ODDS)).select("pregunta_id", F.lit(True).alias("other"))

    judged = looked.join(shapes, "shape", "left").join(F.broadcast(classes), ["kind", "run"], "left").join(words, ["kind", "word", "run"], "left").join(other, "pregunta_id", "left")
    refused = (F.coalesce("seen", F.lit("")) == "refusal") | F.coalesce("declining", F.lit(False))
    defect = (
        F.when(F.col("seen") == "empty", "empty")
        .when(refused & F.col("right"), None)
        .when(refused, "refusal")
        .when(F.col("seen") == "copy", "copy")
        .when(~F.col("listed") & (chance < TERMINAL), "truncated")
        .when(F.col("other"), "language")
    )
    return judged.select("pregunta_id", defect.alias("defect")).where("defect is not null")
