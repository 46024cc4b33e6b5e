"""Language of a sentence by script and function words; enough to tell a few large languages apart."""

from __future__ import annotations

import re

# The most frequent function words of each language.
MARKERS = {
    "en": "the a and of to in is was it that with as for on are be been by this or an at from but not have has had which you they we he she his her my your our their who would could should will can if there then than when what how why where do does did all one into about out up so no me him them some only over also more any these those were without before after until because while nobody",
    "de": "der die das und nicht ist ein eine einen einem einer eines den dem des zu mit auf im in am von vom als wenn dann auch noch wird war waren sie ich wir er ihr wie warum über nach bis es sich aber oder hatte hatten hat haben sein seine ihre kein keine nur mehr vor aus bei für durch um so was da unter zum zur mich mir dass doch schon immer ohne weil niemand",
    "fr": "le la les des et est une un du de que qui ne pas plus dans sur avec pour par au aux il elle ils elles on nous vous je se ce cette ces mais ou où son sa ses leur en y étaient était être avoir avait a été comme si tout sans sous pourquoi quand même jusque encore avant après personne",
    "es": "el la los las y o es una un de del que en por con para se su sus al lo le pero como más si no fue era había ha hay me mi muy sin sobre este esta entre cuando todo también hasta desde donde porque qué quién otra otro nadie ni ya antes después",
    "it": "il lo la i gli le e è una un uno di del della dei delle che in per con non si su al alla dal nel nella sul ma come più perché quando fino era erano aveva ho ha sono questo questa anche suo sua loro così ancora prima dopo senza nessuno",
    "nl": "het de een en van is dat in op te met voor niet zijn ook maar wat die als waarom toen naar bij nog was waren er aan om hij zij ze ik je wij dan over uit had heeft hebben worden werd tot deze dit geen hun zonder omdat niemand voordat",
    "pt": "o os a as e é uma um de do da dos das que em no na por com para se não mas como mais quando até foi era seu sua ele ela ao sem sobre muito também já ninguém",
}
OF: dict[str, list[str]] = {}
for _lang, _words in MARKERS.items():
    for _w in set(_words.split()):
        OF.setdefault(_w, []).append(_lang)
WORD = re.compile(r"[^\W\d_]+")
SCRIPTS = (("zh", re.compile("[一-鿿]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ja", re.compile("[぀-ヿ]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ko", re.compile("[가-힯]")), ("he", re.compile("[֐-׿]")))
OTHER_SCRIPT = re.compile("[Ͱ-ϿЀ-ӿ֐-׿؀-ۿ぀-ヿ一-鿿가-힯]")
ENDINGS = (("en", re.compile(r"[a-z]{3,}(?:ing|ly)\b")), ("de", re.compile(r"[a-z]{3,}(?:ung|lich|keit)\b")), ("it", re.compile(r"[a-z]{3,}(?:zione|mente|ando)\b")), ("nl", re.compile(r"[a-z]{3,}(?:lijk|heid|tje)\b")))
ACCENTS = (("de", "äöüß"), ("es", "ñ¿¡"), ("fr", "çêèœ"))


def votes_of(text: str) -> dict[str, float]:
    """How much speaks for each language: its script alone, or else function words, shared ones in parts, and letters of its own; endings where that leaves it open."""
    votes: dict[str, float] = {}
    plain = text.isascii()
    if not plain and OTHER_SCRIPT.search(text):
        letters = sum(map(str.isalpha, text))
        for code, rx in SCRIPTS:
            if len(rx.findall(text)) * 2 > letters:
                return {code: float(letters)}
    low = text.lower()
    for own in map(OF.get, WORD.findall(low)):
        if own:
            for code in own:
                votes[code] = votes.get(code, 0) + 1 / len(own)
    if not plain:
        for code, marks in ACCENTS:
            if any(c in low for c in marks):
                votes[code] = votes.get(code, 0) + 0.75
    elif decided(votes) is None:
        for code, rx in ENDINGS:
            if rx.search(low):
                votes[code] = votes.get(code, 0) + 0.5
    return votes


def decided(votes: dict[str, float]) -> str | None:
    """The language that most speaks for, if that is enough and clearly more than for the next."""
    best = sorted(votes.items(), key=lambda x: -x[1])
    return best[0][0] if best and best[0][1] >= 1 and (len(best) == 1 or best[0][1] > best[1][1] + 0.3) else None


def language(text: str) -> str | None:
    """Language code of a sentence, or None where it can't be told."""
    return decided(votes_of(text))


def rules_out(text: str, code: str) -> bool:
    """Whether a text, though its own language may be in doubt, is not in this one: more speaks for another, or it has letters of another script."""
    votes = votes_of(text)
    latin = not any(code == c for c, _ in SCRIPTS)
    return votes.get(code, 0) < max(votes.values(), default=0) or (not latin and code not in votes and any(map(str.isalpha, text)))
