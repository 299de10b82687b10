"""Operator 4, quality rules: line-first cleaning, in DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate, symbols; with word lists in English, German, French
and Spanish, whatever the document's language), failing lines are removed, and a document is rejected when the removed lines held too many of its words, or by the whole-text rules (too few words, too
much verbatim repetition).

Defined cases: a null text is an empty one; a text without words is rejected (too few words) and its cleaned text is
what is left of it; lines without a word are never judged and stay. Rows are independent: repeated rows, tied or null ids
give a result row each. Columns other than the id and the text are ignored, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, n_words, text_of, words

SYMBOLS = r"[#*$%&|<>]"
#: A line may end so.
TERMINAL = r"""[.!?:;,…。！？"'”’»)\]}][\x20\x09-\x0D]*$"""
#: Marks between the items of a menu or a breadcrumb.
SEPARATORS = r"(?:^|[\x20\x09])[|>»›•·/\\](?=[\x20\x09]|$)"
#: Words and phrases of menus, and of boilerplate, in the languages the rules know. Letters beyond A-Z stand in both cases.
MENU_WORDS = {
    "en": "home|menu|login|log in|log out|sign in|sign up|register|search|contact|contact us|about|about us|sitemap|next|previous|back|top|share|print|faq|help|cart|checkout|blog|news|archive|categories|tags",
    "de": "startseite|anmelden|abmelden|registrieren|suche|suchen|kontakt|impressum|datenschutz|weiter|zur[üÜ]ck|nach oben|teilen|drucken|hilfe|warenkorb|kasse|[üÜ]ber uns|nachrichten|archiv|kategorien",
    "fr": "accueil|connexion|d[éÉ]connexion|inscription|recherche|rechercher|[àÀ] propos|plan du site|suivant|pr[éÉ]c[éÉ]dent|retour|haut de page|partager|imprimer|aide|panier|mentions l[éÉ]gales|actualit[éÉ]s|cat[éÉ]gories",
    "es": "inicio|iniciar sesi[óÓ]n|cerrar sesi[óÓ]n|registrarse|buscar|b[úÚ]squeda|contacto|acerca de|sobre nosotros|mapa del sitio|siguiente|anterior|volver|arriba|compartir|imprimir|ayuda|carrito|noticias|archivo|categor[íÍ]as",
}
BOILERPLATE_PHRASES = {
    "en": "cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|powered by|enable javascript|click here|read more|subscribe to|newsletter|share this|follow us|skip to content|accept (?:all )?cookies|lorem ipsum",
    "de": "cookie-richtlinie|datenschutzerkl[äÄ]rung|nutzungsbedingungen|alle rechte vorbehalten|javascript aktivieren|hier klicken|weiterlesen|mehr lesen|abonnieren|folgen sie uns|zum inhalt springen|cookies (?:akzeptieren|zulassen)",
    "fr": "politique de (?:confidentialit[éÉ]|cookies)|conditions d.utilisation|tous droits r[éÉ]serv[éÉ]s|activer javascript|cliquez ici|lire la suite|en savoir plus|abonnez-vous|suivez-nous|aller au contenu|accepter les cookies",
    "es": "pol[íÍ]tica de (?:privacidad|cookies)|t[éÉ]rminos de uso|todos los derechos reservados|activar javascript|haga clic aqu[íÍ]|leer m[áÁ]s|suscr[íÍ]bete|s[íÍ]guenos|saltar al contenido|aceptar (?:las )?cookies",
}
MENU = rf"(?i)^[\x20\x09-\x0D]*(?:(?:{'|'.join(MENU_WORDS.values())})[\x20\x09|>»›•·/,]*)+$"
#: A phrase begins where a word does.
BOILERPLATE = rf"(?i)(?<![A-Za-z])(?:{'|'.join(BOILERPLATE_PHRASES.values())})"


def line_fails(line: Column, n: Column, *, short_line: int = 5, boilerplate_words: int = 25) -> Column:
    """Whether a line of n words, one or more, must go: unfinished and short, a menu, boilerplate, or mostly marks."""
    unfinished = (n < short_line) & ~line.rlike(TERMINAL)
    menu = (F.regexp_count(line, F.lit(SEPARATORS)) * 3 > n) | line.rlike(MENU)
    boilerplate = (n <= boilerplate_words) & line.rlike(BOILERPLATE)
    marks = F.regexp_count(line, F.lit(SYMBOLS)) > n
    shouting = (n >= 5) & (F.regexp_count(line, F.lit(r"[!?]{2,}")) * 3 > n)
    return unfinished | menu | boilerplate | marks | shouting


def repeated_words(ws: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that the text has twice or more."""

    def neighbours(s: Column) -> Column:
        found = F.transform(
            s,
            lambda e, k: F.when(
                F.coalesce((F.get(s, k - 1)["h"] == e["h"]) | F.lit(False), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)),
                e["i"],
            ),
        )
        return let(
            F.sort_array(F.filter(found, lambda i: i.isNotNull())),
            lambda p: F.aggregate(
                F.transform(p, lambda e, j: F.coalesce(F.least(F.lit(width), F.get(p, j + 1) - e), F.lit(width))), F.lit(0), lambda a, x: a + x
            ),
        )

    def covered(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), neighbours)
        )

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: F.xxhash64(F.slice(ws, i, width)))
    return F.when(F.size(ws) <= width, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_removed_percent: int = 40,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: the counts, removed_lines, removed_words, cleaned_text, base_failed and kept.

    carry: input columns to pass through in a struct `carried` instead of the id.
    """
    keep, name = (F.struct(*carry), "carried") if carry else (F.col(id_col), id_col)
    rows = docs.select(keep.alias("__kept"), text_of(text_col).alias("__text"))
    per_text = let(
        words(F.col("__text")),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated_words(ws).alias("n_repeat_words")
        ),
    )

    def of_lines(judged: Column) -> Column:
        worded = F.transform(F.filter(judged, lambda x: x["n"] > 0), lambda x: x["line"])
        failing = F.filter(judged, lambda x: x["fails"])
        return F.struct(
            let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
            F.size(failing).cast("long").alias("removed_lines"),
            F.aggregate(failing, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("removed_words"),
            F.when(F.size(failing) == 0, F.lit(None)).otherwise(F.array_join(F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")).alias("cleaned"),
        )

    judged = F.transform(
        F.split(F.col("__text"), "\n"),
        lambda line: let(n_words(line), lambda n: F.struct(line.alias("line"), n.alias("n"), F.when(n > 0, line_fails(line, n)).otherwise(F.lit(False)).alias("fails"))),
    )
    # generated, so that a filter on the verdict doesn't compute all again
    found = F.struct(per_text.alias("__w"), let(judged, of_lines).alias("__l"), F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    rows = rows.select("__kept", "__text", F.inline(F.array(found)))
    n = F.col("__w.n_words")
    failed = (n < min_words) | (F.col("__w.n_repeat_words") * 100 > n * max_repeat_percent)
    return rows.select(
        F.col("__kept").alias(name),
        n.alias("n_words"),
        F.col("__w.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("__l.n_dup_lines").alias("n_dup_lines"),
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("__l.removed_words") * 100 <= n * max_removed_percent)).alias("kept"),
        F.col("__l.removed_lines").alias("removed_lines"),
        F.col("__l.removed_words").alias("removed_words"),
        F.coalesce(F.col("__l.cleaned"), F.col("__text")).alias("cleaned_text"),
    )
