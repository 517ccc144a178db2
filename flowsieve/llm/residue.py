"""Template residue, filler, error pages and script notices in place of content.

Markup is taken off, and what stands in backticks or double quotes is blanked (texts that quote such things are no
cases). A text is tokenised once; three detectors judge it:

* placeholder: an unfilled mark of a template language (pairs of delimiters around a name, format directives), or a word
  that programs print for a missing value where a value should stand. Marks that the sentence talks about ("{name}
  style fields") are none.
* filler: sentences of five or more words without any function word (two of them, or one that is a paragraph of its own
  and no heading or list), a line that says the same words again, a to-do mark at the start, or a sentence that asks
  the author to write (edit verb and slot: "type ... here", "replace this paragraph") or names itself sample text.
* response: slug, title and body terms are compared. Only low-information texts (at most `most_words` distinct words)
  are looked at; body words that are usual in the corpus (at least `rare_share` of all documents hold them) or repeat
  the slug or the title speak for content, the others are a mismatch. A mismatching word is a response word if it is a
  term of error messages and script notices, or by evidence of the hosts: at least `answers` low-information texts of
  several hosts hold it, and these are at least half of all texts that do. A text is a response if response words make
  at least `mismatch` of the words of its title and body that are no function words.

The host evidence needs no phrases and finds responses in any language once they are repeated; the terms find single
ones. Only texts with a term of filler, a doubled word or a run of words without function words are cut into sentences.

Defined results: null or empty texts are no cases; repeated texts are judged alike; very long texts are judged whole;
a null host or slug adds no evidence; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import scratch

#: Marks of template languages that are left unfilled.
MARKS = [
    r"\{\{\s*[A-Za-z_][\w .|-]*\}\}", r"[$#@]\{\s*[A-Za-z_][\w.]*\s*\}", r"(?<![{$#@\w])\{(?:[A-Za-z_][A-Za-z_ ]*|\d{1,2})\}(?!\})", r"\[\[\s*[A-Za-z_][\w ]*\]\]",
    r"(?:<%|\[%|\{%)[=-]?\s*[A-Za-z_][\w. ]*-?(?:%>|%\]|%\})", r"<<\s*[A-Za-z_][\w ]*>>", r"@@[A-Za-z_]+@@", r"%%[A-Za-z_]+%%", r"(?<!\w)__[A-Za-z][A-Za-z_]*?__(?!\w)",
    r"%\([A-Za-z_]+\)[sdfSDF]", r"(?<![\w%])%(?:\.\d+)?[sdfSDF](?!\w)", r"(?<![\w%])%[A-Z_]{3,}%", r"(?<!\[)\[[A-Z]{2,}(?:[ _][A-Z]+)*\](?!\])",
    r"(?i:<(?:insert|enter|your|add|fill in|put)\b[^<>]*>)", r"(?i:\[(?:insert|enter|your|add|fill in|put)\b[^\[\]]*\])",
]
#: A word after a mark or a null word that shows that the sentence talks about it.
TALKED_OF = r"(?!['\"`]?[ -](?:styles?|syntax|placeholders?|templates?|tags?|marks?|markers?|notation|expressions?|payloads?|strings?|values?|behaviou?r|symbols?|variables?|functions?|results?|hypothes[ie]s|models?|pointers?|checks?|keyword|literals?)\b)"
#: Words that a program prints for a missing value, where they stand as a value.
NULL_WORDS = [
    r"(?<![\w\"'`/-])(?:undefined|UNDEFINED)(?![\w\"'`/-])", r"(?<=[a-z,] )None(?! of\b)(?![\w\"'`/-])", r"(?:^|[.!?]\s+)None(?= (?!was|his|its|this)\w*[a-z]s\b)",
    r"(?<=\b(?:seed|than|from|to|by|of|on|at|was|only|about|stayed|auf|um|bei|von|de|à|en|sur|por) )(?:NaN|nan|NAN|null|NULL)(?=[.,;:]|$| (?:percent|missing|of)\b| \p{L}{3,}s\b)", r"(?<![\w\"'-])(?:TBD|TBA|TBC)(?![\w\"'-])",
]
#: Words without which no sentence is looked at as filler: to-do marks, edit verbs, names of sample text.
FILLER_TERMS = (
    "lorem ipsum todo tbd tba fixme placeholder placeholders sample dummy filler example soon your here insert type enter add replace write edit click paste fill "
    "platzhalter platzhaltertext blindtext mustertext beispieltext hier einfügen ersetzen exemple remplissage ici insérez remplacez saisissez cliquez ejemplo relleno aquí inserte reemplace escriba"
).split()
_SLOT = r"(?:texts?|headings?|titles?|paragraphs?|sections?|sentences?|content|descriptions?|summary|captions?|words|name)"
#: How a sentence in lower case speaks as filler.
FILLER_SPEAKS = [
    r"\blorem ipsum\b", r"^(?:todo|tbd|tba|fixme)\b *(?:[:.-]|$)",
    rf"^(?:please )?(?:insert|type|enter|add|replace|write|edit|click|paste|fill|put)\b.{{0,60}}\b(?:here|this {_SLOT}|your (?:own )?{_SLOT})\b",
    rf"^(?:this is )?(?:an? )?(?:your|sample|placeholder|dummy|example|filler) {_SLOT}(?: (?:goes|comes|stands|here|will|to be|and will|for)\b.*|(?: (?:sample|dummy|example|filler) {_SLOT})*)[.!]?$",
    rf"^{_SLOT} goes here\b", r"^(?:\w+ )?coming soon[.!]?$",
    r"^(?:(?:dies|hier) (?:ist|steht) ein )?(?:platzhalter(?:text)?|blindtext|mustertext|beispieltext)\b", r"^(?:ceci est un |este es un )?text[eo] (?:d'exemple|de remplissage|de ejemplo|de relleno)\b",
    r"^(?:bitte )?(?:hier|diesen text)\b.{0,40}\b(?:einfügen|ersetzen)\b", r"^(?:insérez|remplacez|saisissez|cliquez|inserte|reemplace|escriba)\b.{0,60}\b(?:ici|texte|aquí|texto)\b",
]
#: Terms of error messages and script notices (fixed values): carriers, states and what the reader shall do.
RESPONSE_TERMS = (
    "http https nginx apache proxy gateway server upstream backend session browser javascript js script scripts scripting noscript cookie cookies captcha page webpage website site url link address request requests requested connection database permission login password firewall host token traceback exception stacktrace keyerror valueerror typeerror timeout "
    "error errors denied forbidden unauthorized unauthorised unavailable expired failed failure invalid disabled enabled required requires missing moved deleted removed exist exists found find looking wrong unexpected unable sorry oops whoops maintenance offline locked refused rejected timed blocked broken temporarily currently busy overloaded exceeded limit internal fatal crashed private "
    "access open enable activate allow reload refresh retry return click log sign signed logged again turn turned later contact administrator loading load loaded verify checking redirected view display displayed shown service minutes "
    "fehler serverfehler seite sitzung zugriff verweigert gefunden abgelaufen wartung erreichbar zeitüberschreitung skripte aktivieren erneut versuchen später anmelden angeforderte existiert geladen dienst minuten anzeigen "
    "erreur serveur interne introuvable refusé accès expiré indisponible réessayer veuillez activer navigateur délai dépassé nécessite exécution demandée supprimé déplacé connexion afficher service minutes "
    "servidor interno página encontrada encontrado acceso denegado caducado sesión mantenimiento inténtelo navegador requiere habilitados activar activa espera agotado existe disponible servicio minutos ver "
    "errore pagina trovata accesso negato scaduta manutenzione riprova"
).split()
#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = (
    "a an and are as at be been but by can cannot could do does for from had has have he her his i if in into is it its more my no not of on one only or our out over she so than that the their them then there they this to under up us was we were what when where which who why will with would you your "
    "about after all also any because before between both during each how just may might most must nor off once other some such through until very while re ve ll don isn doesn aren can't "
    "aber alle als am an auch auf aus bei bin bis bitte das dass dem den der des die diese dieser diesen du durch ein eine einem einen einer er es für hat ich ihr ihre im in ist ja kann keine mit müssen nach nicht noch nur oder ohne sein sich sie sind so über um und uns unter vom von vor war wenn werden wie wir wird wurde zu zum zur "
    "au aux avec ce cette ces comme dans de des du elle en est et il ils je la le les leur mais ne nous on ont ou par pas plus pour qu que qui sa sans se ses son sont sous sur un une vos votre vous y à été "
    "al con como cuando de del el ella en entre es esta este estos está están esto fue ha hay la las lo los más me muy no nos o para pero por que se sin sobre son su sus también un una unas uno unos y ya"
).split()

#: A line or sentence of words alone; one that says a word three times in a row; five or more words without numbers.
WORDS_ALONE = r"^\p{L}{2,}(?:\s+\p{L}{2,}){2,}[.!?]?$"
DOUBLED = r"(?<!\S)(\p{L}{2,}+)\s++\1(?!\p{L})"
THREE_TIMES = r"(?<!\p{L})(\p{L}{2,})(?:\s+\1){2}(?!\p{L})"
FOUR_TIMES = r"(?<!\p{L})(\p{L}{2,})(?:\s+\1){3,}(?!\p{L})"
HOLLOW = r"^(?:\p{L}{3,}[ ,]+){4,}\p{L}{3,}[.!?]?$"
#: Where a text may hold a hollow sentence: it begins, has five or more words of three or more letters alone, none of them
#: of the most frequent, and ends.
HOLLOW_SOMEWHERE = r"(?:^|[.!?:)\n])[\s*_>#-]*+(?:(?!(?i:the|and|was|were|for|with|that|are|der|die|das|und|les|des|que|los|las)\b)\p{L}{3,}+[ ,]++){4,}+\p{L}{3,}+[ \t*_>#-]*+(?:[.!?\n]|$)"
#: Headings (at most eight words that begin with a capital) and lists have no closing mark either.
HEADING_OR_LIST = r"^(?:\p{Lu}\S*(?:\s+\S+){0,7}|[^,]*,.*)(?<![.!?])$"

_ANY = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
_ONE_OF = lambda w, terms: w.isin(*sorted(set(terms)))


def plain(text: Column) -> Column:
    """Text without tags and with quotations blanked."""
    quoted = F.regexp_replace(text, r"`[^`\n]*`|\"[^\"\n]{1,120}\"", " codespan ")
    blanked = F.when(text.contains("`") | text.contains('"'), quoted).otherwise(text)
    untagged = F.regexp_replace(blanked, r"(?<!<)</?(?:[a-zA-Z][a-zA-Z0-9]*)(?:\s+[a-zA-Z-]+=(?:\"[^\"]*\"|'[^']*'|codespan))*\s*/?>", "\n")
    return F.when(text.contains("<"), untagged).otherwise(blanked)


def pieces(body: Column, border: str) -> Column:
    return F.filter(F.transform(F.split(body, border), lambda s: F.trim(F.regexp_replace(s, r"[\s*_>#-]+$|^[\s*_>#-]+", ""))), lambda s: s != "")


def sentences(body: Column) -> Column:
    return pieces(body, r"(?<=[.!?:)])\s+(?=[^a-z])|\n+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))


def distinct_words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+")), lambda x: F.length(x) >= 2)


def holds(text: Column, marks: list[str]) -> Column:
    """Whether a text holds any of some literals: much cheaper than an expression."""
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def title(body: Column) -> Column:
    """The first line, or what stands before its colon, if it is short, has no closing mark and something follows."""
    first = F.regexp_extract(body, r"^\s*([^\n]{1,80}?)(?:[ \t]*\n|:[ \t])\s*\S", 1)
    return F.when((first != "") & ~first.rlike(r"[.!?]$") & (F.size(F.split(first, r"\s+")) <= 8), first).otherwise("")


def _gates(body: Column, w: Column) -> dict[str, Column]:
    """Reasons to cut a text into sentences and look for filler."""
    return {"terms": F.exists(w, lambda x: _ONE_OF(x, FILLER_TERMS)), "doubled": body.rlike(DOUBLED), "long_words": body.rlike(HOLLOW_SOMEWHERE)}


def _speaks_as_filler(body: Column, units: Column) -> Column:
    """The detector of filler over the sentences of a text, which are null where the words give no reason to look."""
    function_free = lambda s: ~F.exists(words(s), lambda x: _ONE_OF(x, FUNCTION_WORDS))

    def again(s: Column) -> Column:
        said = words(s)
        return s.rlike(WORDS_ALONE) & ((2 * F.size(F.array_distinct(said)) <= F.size(said)) | F.lower(s).rlike(THREE_TIMES)) & function_free(s)

    hollow = lambda s: s.rlike(HOLLOW) & function_free(s)
    spoken = F.exists(units, lambda s: F.lower(s).rlike(_ANY(FILLER_SPEAKS)) & (F.size(words(s)) <= 16))
    said_again = F.exists(units, lambda s: F.lower(s).rlike(FOUR_TIMES) | again(s))
    n_hollow = F.size(F.filter(units, hollow))
    apart = F.exists(pieces(body, r"\n\s*\n"), lambda p: hollow(p) & ~p.rlike(HEADING_OR_LIST))
    return (
        F.when(F.col("terms"), spoken).otherwise(False)
        | F.when(F.col("doubled"), said_again).otherwise(False)
        | F.when(F.col("long_words"), F.when(F.size(units) == 1, n_hollow == 1).otherwise(F.when(n_hollow >= 2, True).otherwise((n_hollow == 1) & apart))).otherwise(False)
    )


def detect(
    documents: DataFrame, id: str, text: str, host: str, slug: str | None = None, rare_share: float = 0.01, mismatch: float = 0.5, most_words: int = 40, answers: int = 3
) -> DataFrame:
    """id and the detectors' verdicts: placeholder, filler, notice, response; `residue`: any of them."""
    slugs = F.col(slug) if slug else F.lit(None).cast("string")
    docs = documents.select(F.col(id).alias("id"), F.col(host).cast("string").alias("host"), slugs.alias("slug"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bodies = docs.select("id", "host", "slug", plain(F.col("text")).alias("body")).withColumn("w", distinct_words(F.col("body")))
    bodies = bodies.withColumns(_gates(F.col("body"), F.col("w")))
    bodies = bodies.withColumn("units", F.when(F.col("terms") | F.col("doubled") | F.col("long_words"), sentences(F.col("body"))))
    # cheap conditions first: most texts hold neither brackets nor null words
    marked = F.when(holds(F.col("body"), ["{", "[", "<", "%", "@@", "__"]), F.col("body").rlike(rf"(?:{_ANY(MARKS)}){TALKED_OF}")).otherwise(False)
    nulls = F.when(holds(F.col("body"), ["undefined", "UNDEFINED", "None", "NaN", "NAN", "nan", "null", "NULL", "TBD", "TBA", "TBC"]), F.col("body").rlike(rf"(?:{_ANY(NULL_WORDS)}){TALKED_OF}")).otherwise(False)
    low = F.size("w") <= most_words
    told = F.array_distinct(words(F.concat_ws(" ", F.regexp_replace(F.coalesce("slug", F.lit("")), "_", " "))))
    judged = bodies.select(
        "id", "host", (marked | nulls).alias("placeholder"), _speaks_as_filler(F.col("body"), F.col("units")).alias("filler"),
        "w", (low & (F.size("w") > 0)).alias("low"),
        F.when(low, F.array_distinct(words(title(F.col("body"))))).alias("t"), F.when(low, told).alias("slug"),
    )
    judged, _ = scratch.cut(judged)  # each text is read and tokenised once
    response = _responses(judged, docs.count(), rare_share, mismatch, answers)
    verdicts = [F.coalesce(c, F.lit(False)).alias(c) for c in ("placeholder", "filler", "notice", "response")]
    out = judged.select("id", "placeholder", "filler").join(response, "id", "left").select("id", *verdicts)
    return out.withColumn("residue", F.col("placeholder") | F.col("filler") | F.col("notice") | F.col("response"))


def _responses(judged: DataFrame, n_docs: int, rare_share: float, mismatch: float, answers: int) -> DataFrame:
    """id, notice (by terms alone), response (terms and hosts) of the low-information texts that answer instead of telling."""
    own_host = F.when(F.col("low"), F.col("host"))
    stats = (
        judged.select(F.explode("w").alias("word"), "low", own_host.alias("host"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"), F.count_if("low").alias("e"), F.min("host").alias("h0"), F.max("host").alias("h1"))
        .where(F.col("e") > 0)
    )
    usual = F.col("df") >= F.greatest(F.lit(2.0), F.lit(rare_share * n_docs))
    by_hosts = ~usual & (F.col("e") >= answers) & (F.col("h0") != F.col("h1")) & (2 * F.col("e") >= F.col("df"))
    stats = stats.select("word", by_hosts.alias("by_hosts"), usual.alias("usual"))
    # a word of the title alone counts only if it is a response word; what the body shares with the slug agrees
    terms = judged.where("low").select("id", F.explode(F.filter("w", lambda x: ~_ONE_OF(x, FUNCTION_WORDS))).alias("word"), "t", "slug")
    terms = terms.select("id", "word", F.array_contains("t", F.col("word")).alias("in_title"), F.array_contains("slug", F.col("word")).alias("in_slug"))
    by_term = ~F.col("in_slug") & _ONE_OF(F.col("word"), RESPONSE_TERMS)
    met = terms.join(stats, "word").select("id", "in_title", "usual", by_term.alias("term"), (by_term | (~F.col("in_slug") & F.col("by_hosts"))).alias("answer"))
    told = lambda c: [F.count_if(c).alias(f"n_{c}"), F.count_if(~F.col(c) & ~F.col("in_title")).alias(f"rest_{c}"), F.count_if(~F.col(c) & F.col("usual") & ~F.col("in_title")).alias(f"content_{c}")]

    def found(c: str) -> Column:
        n, rest = F.col(f"n_{c}"), F.col(f"rest_{c}")
        return (n > 0) & ((n >= 2) | (rest == 0)) & (n >= mismatch * (n + rest)) & (n > F.col(f"content_{c}"))

    per = met.groupBy("id").agg(*told("term"), *told("answer"))
    return per.select("id", found("term").alias("notice"), found("answer").alias("response")).where("notice or response")
