"""The main body of web pages: two-pass block rules over the lines of a page.

Pass one decides what it can from a block alone: stop-word density, length and link density, cue words of notices,
share prompts and link lists, the page's title. Pass two lets the ambiguous short blocks (headings, link titles, menu
words) inherit the label of their nearest decided neighbours. A map over the pages, no corpus state, no shuffle but
the one that makes repeated deliveries count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words of the corpus languages (fixed list): the density of prose in them is above a third.
STOP_WORDS = frozenset(
    """a about after all an and any are as at be because been before but by can could do does for from had has have he
    her his how i if in into is it its no not of off on once one only or our out over she since so some such than that
    the their them then there these they this those through to until up was we were what when where which while who why
    will with without would you your
    aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer es für
    gegen hat haben ich im in ist je kein keine man mit nach nicht noch nur ob oder ohne seit sich sie sind so über um
    und uns unter vom von vor was weil wenn werden wie wir wird wurde zu zum zur
    al como con contra cuando de del desde donde el ella en entre es esta este esto fue ha han hasta la las lo los más
    me mientras muy ni no nos o para pero por porque que qué se según ser si sin sobre su sus también tras un una uno y ya
    à au aucun aux avec ce ces cette comme dans de depuis des dont du elle en est et il ils je l la le les leur leurs
    lorsque mais ne nous on ont où ou par parce pas pendant plus pour qu quand que qui sa sans se selon ses si son sont
    sur tous tout un une vous""".split()
)

#: Cues, on the case-folded line with single spaces, of blocks that are never part of an article (fixed list).
_BAD = (
    # notices about storage and privacy
    r"(?:we|this site|.{1,40}) and (?:our )?\d+ partners\b", r"by (?:continuing|scrolling|browsing|using)\b.*\byou (?:agree|accept)", r"your privacy (?:is up to you|matters)",
    r".{0,40}\b(?:und|&) \d+ partner\b.*cookies?", r"(?:mit|durch) (?:der|die) (?:weiteren? )?nutzung\b.*stimmen sie", r"ihre privatsphäre", r"(?:usamos|.{1,30} usa) cookies\b", r"si sigue navegando", r"su privacidad",
    r"(?:nous utilisons|.{1,30} utilise) des cookies\b", r"en poursuivant\b.*vous acceptez", r"votre vie privée", r".*\b(?:accept all|got it|alle annehmen|aceptar todo|tout accepter)\b.{0,30}$",
    # navigation and page tools
    r"skip to (?:content|main)", r"(?:zum inhalt|saltar al contenido|aller au contenu)", r"back to top", r"nach oben", r"volver arriba", r"haut de page", r"copy link\b", r"print\b.{0,30}$", r"drucken\b.{0,40}$", r"imprimir\b.{0,40}$", r"imprimer\b.{0,40}$",
    r"share (?:on|this|via)\b", r"teilen\b ?:", r"compartir\b ?:", r"partager\b ?:", r"(?:language|sprache|idioma|langue) ?:", r"(?:cart|warenkorb|carrito|panier) \(\d", r"follow [^.]{1,40}:", r"[^.]{1,40} folgen ?:", r"(?:siga|sigue|síganos|suivez|suivre|seguir)\b[^.]{1,60}:",
    r"(?:rate this page|seite bewerten|valore esta página|noter cette page)", r"(?:report a problem|problem melden|fehler melden|informar de|signaler un|avisar de)", r"(?:comments? are closed|kommentare (?:sind )?geschlossen|comentarios cerrados|commentaires fermés)",
    r"(?:was this useful|liked this|war das nützlich|hat ihnen|¿?le ha sido útil|¿?le gustó|cela vous a|utile ?\?)",
    # offers of letters, advertising
    r"get the .{1,60}inbox", r"stay in the loop", r"never miss\b", r"(?:der|den) (?:rundbrief|newsletter) (?:von|aus)\b", r"reciba el boletín", r"recevez la lettre", r"(?:advertisement|sponsored|partner content|anzeige|gesponsert|werbung|publicidad|patrocinado|publicité|sponsorisé|contenu partenaire|contenido (?:patrocinado|de socios)|partnerinhalt)(?: content| post)?$",
    r"(?:continue reading|weiterlesen|weiter unten|siga leyendo|sigue leyendo|continúe|lire la suite|la suite)\b.{0,40}$", r"(?:access denied|zugriff verweigert|acceso denegado|accès refusé)\b",
    # legal
    r"©", r".{0,80}\b(?:all rights reserved|alle rechte vorbehalten|todos los derechos reservados|tous droits réservés)", r"(?:all marks belong|marken gehören|les marques citées|las marcas|prohibida la reproducción|reproduction interdite|nachdruck|alle angaben ohne)",
    r"nothing on this page is", r"[^.]{1,40} offers no \w+ advice", r"[^.]{1,40} is hosted (?:by|on)\b", r"[^.]{1,40} no se hace responsable", r"[^.]{1,40} (?:haftet nicht|prüft nicht)", r"(?:imprint|impressum|aviso legal|mentions légales)\b.{0,60}$",
    # walls
    r"please (?:sign|log) in\b", r"(?:bitte )?(?:melden sie sich an|anmelden, um)", r"(?:por favor,? )?(?:inicie|inicia) sesión", r"(?:veuillez vous connecter|connectez-vous)", r".{0,60}\b(?:create an account|konto anlegen|cree una cuenta|créez un compte)\b",
    r"[45]\d\d\b ?[–—:-]", r"(?:checking your browser|(?:wir )?(?:prüfen|prüfe) ihren browser|comprobando su navegador|vérification de votre navigateur)\b",
    # single cross references
    r"(?:see also|related|read also|read next|read more|also read|siehe auch|lesen sie auch|auch lesenswert|mehr dazu|dazu|vea también|véase también|ver también|lea también|relacionado|le puede interesar|voir aussi|lire aussi|à lire aussi|à lire|lié) ?:",
)
#: Cues of the heads of link lists: the ambiguous blocks after them are their links.
_HEADS = (
    r"(?:you may also like|most read|most popular|trending(?: now)?|more from\b.{1,40}|popular now|latest|related (?:articles|stories|posts)|recommended(?: for you)?)$",
    r"(?:mehr von\b.{1,40}|meistgelesen|das könnte sie auch interessieren|auch interessant|im trend|gerade beliebt|neueste)$",
    r"(?:más de\b.{1,40}|lo más leído|también le puede interesar|le puede interesar|tendencias|lo último|recomendado)$",
    r"(?:encore sur\b.{1,40}|les plus lus|vous aimerez aussi|à lire aussi|tendances?|en ce moment|plus de\b.{1,40}|à la une)$",
)
_BYLINE = re.compile(r"(?:reported by|written by|words by|text by|by|von|text:|bericht:|por|texto:|par|texte ?:|de) [^.:|]{3,80}$", re.I)
_LISTED = re.compile(r"(?:[-*•–‣]|\d{1,3}[.)]) \S")
_SEPARATED = re.compile(r" ?[·|/>»›•] ?| {2,}|\t")
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"\w[\"'”»)\]%`]*\s?[.!?…][\"'”»)\]]*(?:\s|$)")

GOOD, BAD, SHORT, HEAD = "good", "bad", "short", "head"


@lru_cache(maxsize=1)
def _rules() -> tuple[re.Pattern, re.Pattern]:
    return re.compile("|".join(_BAD)), re.compile("|".join(_HEADS))


def _plain(line: str) -> str:
    return " ".join(line.split())


def brand_of(domain: str | None) -> str:
    """The distinctive part of a host: its second-level label without a trailing code."""
    labels = (domain or "").lower().split(".")
    return labels[-2].split("-")[0] if len(labels) >= 2 else ""


def title_of(title: str | None, brand: str) -> str:
    """The article's title out of a page title that may end in the site's name."""
    t = _plain(title or "")
    m = re.match(r"(.{4,}) (?:[–\-|—·]|::?) ([^–|—]{1,40})$", t)
    return _plain(m[1]) if m and brand and m[2].casefold().replace(" ", "").startswith(brand) else t


def link_density(raw: str) -> float:
    """Share of a line's characters in link-like segments: short, without sentence marks, between separators."""
    parts = [p for p in _SEPARATED.split(raw.strip()) if p.strip()]
    if len(parts) < 3:
        return 0.0
    linked = sum(len(p) for p in parts if len(p.split()) <= 3 and not any(c.isdigit() for c in p))
    return linked / max(1, sum(map(len, parts)))


def stop_density(line: str) -> float:
    words = _WORD.findall(line.casefold())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(raw: str, brand: str) -> str:
    """Label of one non-blank line by itself; short lines recur, so their labels are remembered."""
    return _remembered(raw, brand) if len(raw) <= 120 else _first_pass(raw, brand)


@lru_cache(maxsize=200_000)
def _remembered(raw: str, brand: str) -> str:
    return _first_pass(raw, brand)


def _first_pass(raw: str, brand: str) -> str:
    line = _plain(raw)
    folded = line.casefold()
    bad, heads = _rules()
    if heads.match(folded):
        return HEAD
    if bad.match(folded):
        return BAD
    if brand and len(line) < 120 and re.match(re.escape(brand) + r"\w* ?:", folded):
        return BAD
    if _LISTED.match(line):
        return GOOD
    if " > " in line or " › " in line or " » " in line:
        return BAD
    if line.count(" | ") >= 2 and any(c.isdigit() for c in line):
        return GOOD
    if link_density(raw) >= 0.5:
        return BAD
    dense = stop_density(line)
    if len(line) >= 60 and dense >= 0.1 and _STOP.search(line):
        return GOOD
    if len(line) >= 140 and dense >= 0.1:
        return GOOD
    if len(line) >= 25 and dense >= 0.2 and _STOP.search(line) and not line.endswith("…"):
        return GOOD
    return SHORT


def classify(text: str, title: str | None, domain: str | None) -> list[tuple[int, str]]:
    """``(line number, good or bad)`` of every non-blank line of a page."""
    brand = brand_of(domain)
    lines = [(n, raw) for n, raw in enumerate(text.split("\n"), 1) if raw.strip()]
    label = [first_pass(raw, brand) for _, raw in lines]
    named = title_of(title, brand).casefold()
    plain = [_plain(raw) for _, raw in lines]
    trail = next((p.rsplit(" > ", 1)[1].casefold() for p in plain if " > " in p), "")
    # where the article begins: its title, else the breadcrumb's last part, else the short block before the body
    at = next((i for i, p in enumerate(plain) if named and p.casefold() == named), None)
    if at is None and trail:
        at = next((i for i, p in enumerate(plain) if p.casefold() == trail), None)
    goods = [i for i, x in enumerate(label) if x == GOOD]
    if at is None and goods:
        i = goods[0] - 1
        while i >= 0 and (label[i] in (BAD, HEAD) or _BYLINE.match(plain[i]) or _signed(plain[i], brand)):
            i -= 1
        at = i if i >= 0 and label[i] == SHORT and goods[0] - i <= 4 else None
        begin = at if at is not None else goods[0]
    else:
        begin = at if at is not None else 0
    end = max([i for i in goods if i >= begin], default=begin if at is not None else -1)
    if at is not None:
        label[at] = GOOD
        for i in (at + 1, at + 2, at + 3):  # the byline stands next to the title
            if i < len(lines) and label[i] == SHORT and (_BYLINE.match(plain[i]) or _signed(plain[i], brand)):
                label[i] = GOOD
                end = max(end, i)
                break
            if i < len(lines) and label[i] == GOOD:
                break
    for i in range(len(lines)):
        if i < begin or i > end:
            label[i] = BAD
    inline = {i for i in range(begin, end + 1) if label[i] == BAD}
    return [(n, x) for (n, _), x in zip(lines, inherit(label, inline), strict=True)]


def inherit(label: list[str], inline: set[int]) -> list[str]:
    """Pass two: short blocks take the label of their nearest decided neighbour, good or bad.

    Blocks in ``inline`` (one-line notices inside the body) decide nothing about others, nor do short ones. Distances
    count blocks between; a heading belongs to what follows it, so of two at equal distance the one ahead decides, and
    a good one ahead from up to twice as far as a bad one behind. Short blocks behind the head of a link list are its
    links, up to the next decided block. Two sweeps, whatever the number of short blocks in a row.
    """
    size = len(label)
    ahead: list[tuple[int, str]] = [(size, BAD)] * size
    near = (size, BAD)
    for i in range(size - 1, -1, -1):
        ahead[i] = near
        if label[i] != SHORT and i not in inline:
            near = (i, label[i])
    out = list(label)
    listing = False
    behind = (-1, BAD)
    for i, x in enumerate(label):
        if x == HEAD:
            listing, out[i] = True, BAD
        elif x == SHORT:
            if listing:
                out[i] = BAD
            elif ahead[i][1] == GOOD and behind[1] == GOOD:
                out[i] = GOOD
            elif ahead[i][1] == GOOD:
                out[i] = GOOD if ahead[i][0] - i <= 2 * (i - behind[0]) else BAD
            else:
                out[i] = GOOD if behind[1] == GOOD and i - behind[0] < ahead[i][0] - i else BAD
        elif i not in inline:
            listing = False
        if x != SHORT and i not in inline:
            behind = (i, x)
    return out


def _signed(line: str, brand: str) -> bool:
    """``Given Family, Site``."""
    name, _, site = line.rpartition(", ")
    return bool(name and brand and site.casefold().startswith(brand) and len(name.split()) <= 5)


def main_body(text: str | None, title: str | None, domain: str | None) -> str | None:
    """The page's text without boilerplate lines; null stays null."""
    if text is None:
        return None
    keep = {n for n, x in classify(text, title, domain) if x == GOOD}
    return "\n".join(raw.strip() for n, raw in enumerate(text.split("\n"), 1) if n in keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        found, bodies = [], []
        for text, title, domain in zip(cols["text"].to_pylist(), cols["title"].to_pylist(), cols["domain"].to_pylist(), strict=True):
            if text is None:
                found.append([])
                bodies.append(None)
                continue
            labels = classify(text, title, domain)
            found.append([n for n, x in labels if x != GOOD])
            keep = {n for n, x in labels if x == GOOD}
            bodies.append("\n".join(raw.strip() for n, raw in enumerate(text.split("\n"), 1) if n in keep))
        yield pa.RecordBatch.from_arrays(
            [cols["event_id"], cols["evidence_id"], pa.array(found, pa.list_(pa.int32())), pa.array(bodies, pa.string())],
            names=["event_id", "evidence_id", "boilerplate", "body"],
        )


def extract_main(events: DataFrame) -> DataFrame:
    """event_id, evidence_id, body and the numbers of the lines left out, for every row of ``events``.

    Needs text, title and domain (any may be null; a null text gives a null body and no lines, a blank one an empty
    body). Lines are numbered from 1 over ``\\n``, blank ones counted. Repeated rows stay: see ``boilerplate_lines``.
    """
    return events.select("event_id", "evidence_id", "text", "title", "domain").mapInArrow(_run, "event_id string, evidence_id string, boilerplate array<int>, body string")


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """``(event_id, evidence_id, line_no)``, once for messages delivered repeatedly.

    Only the numbers are shuffled, as one array per page.
    """
    per = extract_main(pages).select("event_id", "evidence_id", "boilerplate").where(F.size("boilerplate") > 0)
    per = per.groupBy("event_id", "evidence_id", "boilerplate").agg(F.count(F.lit(1)).alias("n"))
    return per.select("event_id", "evidence_id", F.explode("boilerplate").alias("line_no")).distinct()
