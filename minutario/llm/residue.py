"""Template residue and error-page text (problem 9): masked units grouped across sources, phrase and placeholder rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutario.session import cut

#: A group recurs from so many rows in so many sources; where only a word of messages tells, in so many wordings.
ROWS, WORDINGS, SOURCES = 3, 3, 2
#: A group is a message whatever its words from so many rows in so many sources: content is repeated a few times only.
#: Texts that only begin alike must also be short on average, since content that begins alike goes on at length.
WIDE_ROWS, WIDE_SOURCES, SHORT_WORDS = 20, 10, 25
#: Share of a recurring group's texts that must carry a sign of a message.
SIGN_SHARE = 0.5
#: A field recurs from so many texts in so many sources; its name then stands in at least so many kinds of delimiters.
FIELD_TEXTS, FIELD_SOURCES, FIELD_KINDS = 3, 2, 2

REASONS = ("recurring", "placeholder", "unset", "filler", "message")

#: Names that templates give their fields, beside anything with an underscore or in capitals.
FIELD_NAMES = "author owner room summary price title name date time place user client customer company subject topic email phone address signature fecha nombre autor titulo título tema lugar hora sala resumen precio cliente empresa firma correo"
#: The public filler passage that printers use, its words of four letters and more that content does not use.
FILLER = (
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
)
#: Filler has so many words of the passage, each within so many other words of the next.
FILLER_WORDS, FILLER_GAP = 4, 4

_FIELD = r"(?:[A-Za-z]+(?:_[A-Za-z0-9]+)+|[A-Z]{3,}[A-Z0-9]*|(?i:" + "|".join(FIELD_NAMES.split()) + r"))"
_NOTE = r"(?i:[^\[\]<>{}()\n]{0,30}\b(?:insert|placeholder|your|todo|tbd|tba|pendiente|pending|to come|por definir|por completar|texto aqu[ií]|text here|goes here|aqu[ií] va)\b[^\[\]<>{}()\n]{0,30})"
_NAME = r"[\p{L}_][\p{L}\p{N}_ .-]*"

#: Delimiters that say by themselves that a field is meant.
SURE_FIELDS = (
    rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    rf"\{{%\s*{_NAME}\s*%\}}",
    rf"\$\{{\s*{_NAME}\s*\}}",
    rf"<<\s*{_NAME}\s*>>",
    rf"<!--\s*{_NAME}\s*-->",
    rf"\[\[\s*{_NAME}\s*\]\]",
    r"@@[\p{L}_][\p{L}\p{N}_]*@@",
    r"%[\p{L}][\p{L}_]+%",
    r"(?<![\p{L}\p{N}_])__[\p{L}][\p{L}\p{N}_]*?__(?![\p{L}\p{N}_])",
)
#: Delimiters that content uses too: the field must be named, or be a note about missing text.
NAMED_FIELDS = (rf"\[\s*{_FIELD}\s*\]", rf"<\s*{_FIELD}\s*>", rf"(?<!\$)\{{\s*{_FIELD}\s*\}}", rf"«\s*{_FIELD}\s*»", rf"[\[<{{(]{_NOTE}[\]>}})]")
#: Whatever stands in delimiters that fields use, the sure ones first; round brackets only around a note.
DELIMITED = (
    r"\{\{[^{}\n]+\}\}", r"\{%[^{}%\n]+%\}", r"\$\{[^{}\n]+\}", r"<<[^<>\n]+>>", r"<!--[^<>\n]+-->", r"\[\[[^\[\]\n]+\]\]",
    r"@@[\p{L}\p{N}_]+@@", r"%\p{L}[\p{L}_]+%", r"(?<![\p{L}\p{N}_])__\p{L}[\p{L}\p{N}_]*?__", r"\[[^\[\]\n]+\]", r"<[^<>\n]+>", r"\{[^{}\n]+\}",
    r"«[^«»\n]+»", rf"\({_NOTE}\)",
)
#: Values that a template left unset.
UNSET = (
    r"\[object Object\]",
    r"(?m)^[ \t]*[\p{L}][\p{L} _-]{1,30}:[ \t]*(?:undefined|null|None|nil|NaN(?: \p{L}+)?|N/A)[ \t]*\.?\r?$",
)
#: How error and access messages, notices about scripts and notes about missing text begin.
MESSAGES = (
    r"(?:HTTP )?(?:error )?[45]\d\d(?:\s*[:–—-]|\s+(?:bad|unauthori[sz]ed|forbidden|not found|method|request|gone|conflict|too many|internal|not implemented|service|gateway|server|error|http)\b|\s*$|\s*\n)",
    r"error\s*[:–—-]?\s*[45]\d\d\s*(?:[:–—-]|$|\n)",
    r"(?:access|permission) (?:is |was )?denied\b",
    r"acceso (?:denegado|restringido)\b",
    r"(?:you (?:do not|don.t) have|you lack|no tiene) permi",
    r"(?:your|the|su|la) ses+i[oó]n (?:has |have |ha )?(?:expired|timed out|ended|caducado|expirado)",
    r"too many requests\b|demasiadas (?:peticiones|solicitudes)\b",
    r"(?:an )?unexpected error\b|ha ocurrido un error\b|se ha producido un error\b|something went wrong\b|algo sali[oó] mal\b|error inesperado\b|oops\b",
    r"traceback\b|unhandled exception\b|fatal error\b|stack trace\b",
    r"(?:page|document|file|p[aá]gina|documento|acta) (?:not found|no encontrad[oa])\b",
    r"(?:the |this |la |el |esta |este )?(?:page|document|server|service|site|p[aá]gina|servidor|servicio|sitio)[^.\n]{0,40}(?:could not be (?:found|loaded|reached)|is (?:temporarily )?(?:unavailable|down)|no (?:est[aá] disponible|responde|existe))",
    r"(?:connection|request) (?:timed out|refused|reset)\b|service (?:temporarily )?unavailable\b|bad gateway\b|internal server error\b|not found\s*(?:$|\n)|forbidden\s*(?:$|\n)",
    r"(?:please |por favor,? )?(?:log|sign) ?in to (?:read|view|see|continue|access)\b|(?:inicie|inicia) sesi[oó]n para\b",
    r"(?:please |por favor,? )?(?:enable|turn on|activate|active|activa|habilite|habilita)\b[^.\n]{0,40}\b(?:javascript|scripts?|scripting|js|cookies)\b",
    r"(?:you have|your browser has|tiene|su navegador tiene)\b[^.\n]{0,30}\b(?:javascript|scripts?|js)\b[^.\n]{0,20}(?:disabled|off|desactivad|deshabilitad)",
    r"(?:this|the|esta?|la|el) (?:viewer|page|site|app|application|archive|visor|p[aá]gina|sitio|aplicaci[oó]n)[^.\n]{0,20}\b(?:needs?|requires?|necesita|requiere)\b[^.\n]{0,20}(?:javascript|scripts?|scripting|js)\b",
    r"noscript\b|javascript (?:is )?(?:required|disabled|must be enabled|needed)\b|(?:se )?(?:requiere|necesita) javascript\b",
    r"checking (?:that )?your browser\b|checking if the site connection\b|comprobando su navegador\b|verify(?:ing)? you are human\b",
    r"(?:insert|add|enter|type|put|write)\b[^.\n]{0,40}\bhere\b|(?:inserte|escriba|a[nñ]ada|ponga)\b[^.\n]{0,40}\baqu[ií]\b",
    r"\(?\[?(?:your )?text (?:goes )?here\b|\[?texto (?:pendiente|aqu[ií]|de ejemplo|de relleno)\b|contenido (?:de ejemplo|pendiente|provisional)\b|(?:sample|placeholder|dummy) (?:text|copy|content)\b",
    r"(?:todo|tbd|tba|to be (?:determined|announced|completed|added)|por definir|por completar|pendiente de (?:redactar|completar|texto))\b\s*(?:[:.–—-]|\d|$|\n)",
    r"(?:text|content|minutes|summary) (?:is )?(?:to come|to follow|coming soon|pending)\b|coming soon\b|pr[oó]ximamente\b|under construction\b|en construcci[oó]n\b",
    r"(?:xxx+|asdf|test|prueba|foo|bar|blah|qwerty|aaa+|zzz+)(?:[ ,.]+(?:xxx+|asdf|test|prueba|foo|bar|blah|qwerty|aaa+|zzz+|\d+))+\s*[.!]?\s*$",
)
#: Words of messages, a sign in the first clause of a text.
MESSAGE_WORDS = r"(?i)\b(?:javascript|scripting|scripts|cookies|browser|navegador|server|servidor|sign in|log in|reload|recargue|try again|int[eé]ntelo|request id|permission|permiso|session|sesi[oó]n|denied|denegado|unavailable|no disponible|placeholder|sample text|pendiente|administrator|administrador|error|timeout)\b"


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def without_quotes(text: Column) -> Column:
    """Text in back quotes is spoken about, not left over."""
    return F.regexp_replace(text, r"`[^`\n]*`", " ")


def masked(text: Column) -> Column:
    """Lower case with addresses, dates and numbers masked and blanks collapsed; status numbers keep a mask of their own."""
    t = F.regexp_replace(text, r"(?i)\b(?:https?://|www\.)\S+|\b\S+@\S+\.\w+\b|(?<!\S)(?:/[\w.-]+){2,}", "@")
    t = F.regexp_replace(t, r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b", "0")
    t = F.regexp_replace(t, r"(?<![\d.,])[45]\d\d(?![\d.,]*\d)", "§")
    t = F.regexp_replace(t, r"\d+(?:[.,]\d+)*", "0")
    return F.trim(F.regexp_replace(F.lower(t), r"[\s\p{Z}]+", " "))


def beginning(text: Column) -> Column:
    """The first clause: up to a line end, a colon, a semicolon or the end of a sentence."""
    return F.regexp_extract(text, r"^[^\n\r.!?:;]*", 0)


def _recurring(judged: DataFrame, mask: str, whole: bool) -> DataFrame:
    """(mask) of the groups that are messages: exact counts of rows, wordings and sources, summed map-side over hashes."""
    exact = judged.groupBy(mask, "exact").agg(F.count("*").alias("rows"), F.max(F.col("sign")).alias("sign"), F.max("phrase").alias("phrase"), F.max("words").alias("words"))
    groups = exact.groupBy(mask).agg(
        F.count("*").alias("wordings"), F.sum("rows").alias("rows"), F.sum(F.when(F.col("sign"), F.col("rows"))).alias("signs"), F.sum(F.when(F.col("phrase"), F.col("rows"))).alias("phrases"), (F.sum(F.col("words") * F.col("rows")) / F.sum("rows")).alias("words")
    )
    half = SIGN_SHARE * F.col("rows")
    told = (F.col("rows") >= ROWS) & ((F.coalesce("phrases", F.lit(0)) >= half) | ((F.col("wordings") >= WORDINGS) & (F.coalesce("signs", F.lit(0)) >= half)))
    wide = (F.col("rows") >= WIDE_ROWS) & (F.col("words") >= 3)
    if not whole:
        told &= F.col("words") <= 2 * SHORT_WORDS
        wide &= F.col("words") <= SHORT_WORDS
    groups = groups.where(told | wide).select(mask, told.alias("told"), wide.alias("wide"))
    sources = judged.select(mask, "source").distinct().groupBy(mask).agg(F.count("source").alias("sources"))
    return groups.join(sources, mask).where((F.col("told") & (F.col("sources") >= SOURCES)) | (F.col("wide") & (F.col("sources") >= WIDE_SOURCES))).select(mask)


def _templates(judged: DataFrame) -> DataFrame:
    """(key) of texts with a template's field: the fields of all texts are masked and grouped, each group is classified once.

    A group is a field if its delimiters or its name give it away. In delimiters that content uses too, any other name
    is one if it recurs over texts and sources in at least FIELD_KINDS kinds of delimiters.
    """
    each = judged.where(F.size("fields") > 0).select("key", "source", F.explode("fields").alias("field"))
    each = each.select("key", "source", F.regexp_replace(F.regexp_replace("field", r"[\s\p{Z}]+", " "), r"\d+", "0").alias("field"))
    groups = each.groupBy("field").agg(F.count("*").alias("texts"), F.countDistinct("source").alias("sources"))
    known = F.col("field").rlike(r"^(?:" + _any(SURE_FIELDS + NAMED_FIELDS) + ")$").alias("known")
    name = F.lower(F.regexp_extract("field", r"^\W*([\p{L}][\p{L}_-]*[\p{L}])\W*$", 1))
    groups = groups.withColumn("name", name).select("field", known, "name", ((F.col("texts") >= FIELD_TEXTS) & (F.col("sources") >= FIELD_SOURCES) & (F.col("name") != "")).alias("recurs"))
    kinds = groups.where("recurs").groupBy("name").agg((F.count("*") >= FIELD_KINDS).alias("several"))
    fields = groups.where("known").select("field").unionByName(groups.where("recurs and not known").join(kinds.where("several"), "name").select("field"))
    return each.join(fields, "field").select("key").distinct()


def residue_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, reason) for texts that are messages, notices, filler or templates; one row for each key.

    Three units of every text are masked and counted over all records by exact hash: the whole text, its first clause,
    and each field in delimiters. A group of whole texts or of first clauses that recurs over sources is a message if
    most of its texts carry a sign (a message phrase at the beginning, a word of messages in the first clause), or,
    whatever its words, if it recurs widely; first clauses only count if the texts they begin are short on average.
    Field groups are classified by placeholder rules and by recurring in several kinds of delimiters. A text in no
    such group still comes out by the strict rules: a message phrase at its beginning, a value left unset, or words of
    the public filler passage close together.

    reason is the first that holds of recurring, placeholder, unset, filler and message. All counts are exact and
    joined back by hash, so a message that makes up a third of the table is cheap. Null, blank and very short texts
    (under three letters or digits) don't come out; repeated rows come out once; a null source counts for no source.
    """
    given = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")).where(F.col(text).rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}]"))
    given = given.withColumn("bare", F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).withColumn("first", beginning(F.col("bare")))
    passage = "|".join(sorted(FILLER.split(), key=lambda w: (-len(w), w)))
    filler = rf"(?i)\b(?:{passage})\b(?:\W+(?:\w+\W+){{0,{FILLER_GAP}}}?(?:{passage})\b){{{FILLER_WORDS - 1}}}"
    phrase = F.col("bare").rlike(r"(?i)^[\s\p{P}]*(?:" + _any(MESSAGES) + ")")
    strict = (
        F.when(F.col("text").rlike(r"\[object|:[ \t]*(?:undefined|null|None|nil|NaN|N/A)") & without_quotes(F.col("text")).rlike(_any(UNSET)), 3)
        .when(F.col("text").rlike(filler), 4)
        .when(phrase, 5)
    )
    fields = F.when(F.col("text").rlike(r"[\[{<(%@«]|__"), F.regexp_extract_all(without_quotes(F.col("text")), F.lit(_any(DELIMITED)), F.lit(0)))
    judged = cut(given.select(  # the patterns run once over each text
        "key", "source", F.xxhash64("bare").alias("exact"), F.xxhash64(masked(F.col("bare"))).alias("whole"), F.xxhash64(masked(F.col("first"))).alias("clause"),
        F.size(F.split("bare", r"\s+")).alias("words"), phrase.alias("phrase"), F.col("first").rlike(MESSAGE_WORDS).alias("sign"), strict.alias("strict"), fields.alias("fields"),
    ))
    found = [
        judged.join(_recurring(judged, "whole", True), "whole").select("key", F.lit(1).alias("place")),
        judged.join(_recurring(judged, "clause", False), "clause").select("key", F.lit(1).alias("place")),
        _templates(judged).select("key", F.lit(2).alias("place")),
        judged.where("strict is not null").select("key", F.col("strict").alias("place")),
    ]
    first = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min("place").alias("place"))
    return first.select(F.col("key").alias(key), F.element_at(F.array(*map(F.lit, REASONS)), F.col("place")).alias("reason"))
