"""Problem 3: personal information inside free text, by a semi-Markov conditional random field.

Candidate segments (at most ``LONGEST`` characters) are: anything like a mail address however it is disguised, digit groups
of the sizes of telephones and personal documents, street names with a number, and for names every span of up to ``WORDS``
words of a run of capitals, of what follows an introduction or begins with a common given name.  So most places have several
candidates that end, begin or are typed differently.  A segment's features are of the whole span: its shape, the words
inside, the words before and after it, whether it cuts a run.  A segmentation scores the sum over its segments and over the
transitions from each to the next, all else zero, and dynamic programming over the candidates, with the last kind as its
state, chooses boundaries and types jointly.

The weights are trained here, by gradient steps on the conditional likelihood of the labelled sentences that a small
grammar writes (``examples``); none of the project's tables is used, so nothing grows with the data.  The grammar's people
have given names of the list or invented ones, so a name needs no list to be found.  Every text is read whole, in Arrow
batches without a shuffle.

Defined cases: null, empty and blank texts have none (their masked form is themselves); texts are searched in their
consistent form (problem 1), with wrongly decoded stretches read again where that makes letters of them and with words
joined that a line's end breaks; overlapping candidates: the best-scoring set wins, the earlier and longer on a tie;
repeated ids give one row a kind; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookalike import ODD, SPACES, mapped_form
from .mojibake import redecode

LONGEST, WORDS = 120, 6
KINDS = ("email", "telefone", "identidade", "endereco", "nome")

# Words that stand near each kind, common given names, and what names of firms and places are made with.
NEAR = {
    "tel": "tel telefone telefones fone fones cel celular whatsapp zap contato ligar ligue ligação recados recado discar falar fax sms número numero",
    "id": "cpf rg cnh identidade habilitação habilitacao passaporte documento cédula cedula carteira",
    "no": "protocolo registro chave acesso consumidora linha digitável digitavel processo cnpj código codigo matrícula matricula agência agencia autenticação gratuita central cep instalação inscrição estadual boleto lote pedido nota livro série controle doc via barras",
    "home": "residência residencia endereço endereco entrega mora reside residente situado situada domicílio domicilio envelope domiciliado domiciliada sito entregar imóvel correspondência",
}
GIVEN = """ana andré antônio aline alice amanda augusto bárbara beatriz benedito bernardo bianca bruna bruno caio camila carla carlos
carolina cássio cecília célia célio cláudia cláudio cristina dalva daniel daniela débora denise diego diogo douglas edson eduardo
elaine eliane elisa emília érica fabiana fábio fátima felipe fernanda fernando flávia flávio francisca francisco gabriel gabriela
geraldo gilberto gilda giovana guilherme gustavo heitor helena helena henrique hugo igor inês isabel isabela ivan ivone jairo
janaína joana joão joaquim jorge josé juliana júlia júlio karina larissa lauro leandro leonardo letícia lívia lorena lúcia luana
lucas luciana luís luiz luiza mara marcela marcelo márcia márcio marcos margarida maria mariana marina mário marta mateus maurício
mauro miguel míriam mônica murilo nair natália nélson olívia otávio patrícia paula paulo pedro priscila rafael raimundo raquel
regina renata renato ricardo rita roberto rodrigo rogério rômulo rosa rosana rui samuel sandra sebastião sérgio sílvia simone
sônia susana tânia tatiana teresa thiago tiago ulisses valéria vanessa vânia vera vicente vinícius vitor vítor vivian wagner
walter yara zélia""".split()
FIRM = "campo santa santo monte vale lago ilha praia padaria farmácia mercado posto oficina prefeitura secretaria ministério tribunal cartório câmara clube sindicato curso direito estado ponte bairro instituto hospital fundação fundacao escola colégio clínica grupo comercial casa serviços servicos cooperativa banco empresa rua avenida av travessa alameda praça cidade município edifício condomínio faculdade universidade associação igreja parque jardim vila loja marca são porto nova serra barra setor setores"
STOP = "valor total data emissão emitido emitida cpf rg cnh passaporte telefone tel fone cel celular whatsapp contato e-mail email correio referência matrícula importância processo cnpj código unidade linha chave endereço residência registro identidade inscrição protocolo central vencimento entrega mandar enviar ligar responder quem imóvel carteira o a os as um uma no na em para com por que até e-mails acesso encaminhado havia atendeu assinado cliente titular pagador responsável sr sra perfil cópia via mora situado resistência consumo vide conforme marca peça etiqueta modelo acréscimo certidão certidao recados não sob ficou"

_NEAR = {w: k for k, v in NEAR.items() for w in v.split()}


def plain(word: str) -> str:
    """A word in small letters without accents."""
    return word.casefold().translate(_PLAIN)


_PLAIN = str.maketrans("áàâãäéêèëíìîïóôòõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
_GIVEN = {plain(w) for w in GIVEN}
_FIRM, _STOP = {plain(w) for w in FIRM.split()}, {plain(w) for w in STOP.split()}
_LINKS = {"de", "da", "do", "dos", "das", "e", "del", "di"}

_AT = r"(?:\s?@\s?|\s*[\[({<]\s*(?:at|arroba|em)\s*[\])}>]\s*|\s+arroba\s+)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:ponto|dot)\s*[\])}>]\s*|\s+ponto\s+)"
_MAIL = re.compile(rf"[A-Za-z0-9_][\w.+-]*{_AT}[A-Za-z][\w-]*(?:{_DOT}[A-Za-z][\w-]*)+", re.IGNORECASE)
_USER = re.compile(r"[\w.+-]+$")
_MAIL_SIGN = re.compile(r"[\[({<]\s*(?:at|arroba|em)\s*[\])}>]|@|arroba", re.IGNORECASE)
#: An address that is spelled out in words.
_SPELLED = re.compile(r"(?<![\w@.-])[a-z0-9][\w.-]*\s+(?:em|at|arroba)\s+[a-z0-9][\w-]*(?:\s+(?:ponto|dot)\s+[a-z]{2,})+(?!\w)", re.IGNORECASE)
#: A run of what telephones and documents are written with.
_DIGITS = re.compile(r"\d[\d .()\n/+xX-]{5,}")
_SEP = r"[ .\n-]{0,2}"
_PHONE = re.compile(rf"(?<![\w$])(?<!\d[.,/-])(?:\+?55{_SEP}\(?0?[1-9]\d\)?{_SEP}|\(0?[1-9]\d\){_SEP}|0?[1-9]\d[ .\n-])?(?:9{_SEP})?\d{{4}}{_SEP}\d{{4}}(?![\w%])(?![.,/-]\d)")
_CPF = re.compile(r"(?<![\w$])(?<!\d[.,/-])\d{3}[. \n]?\d{3}[. \n]?\d{3}[-. /\n]?\d{2}(?![\w%])(?![.,/-]\d)")
_RG = re.compile(r"(?<![\w$])(?<!\d[.,/-])\d{1,2}\.?\d{3}\.?\d{3}-?[\dXx](?![\w%])(?![.,/-]\d)")
_PASSPORT = re.compile(r"\d{6}(?![\w-])")
_LETTERS = re.compile(r"(?<![\w-])[A-Za-z]{2}[ -]?$")
_STREET = re.compile(
    r"(?<![\w-])(?:r\.|rua|av\.?|avenida|alameda|al\.|travessa|trav\.|tv\.|praça|pça\.?|rodovia|rod\.|estrada|largo|ladeira|viela|beco)\s+"
    r"((?:[^\W\d_][\w.'’-]*\s+){0,5}?[^\W\d_][\w'’-]*)(\s*,\s*|\s+-\s+|\s+)(n\s?(?:[º°o]|[^\w\s]){1,2}\s*|número\s+)?(\d{1,5}(?![\d%/])|s\s?/\s?n[º°o]?(?!\w))",
    re.IGNORECASE,
)
_INTRO = re.compile(
    r"(?<!\w)(assinado\s+por|em\s+nome\s+d[eao]s?|a\s+pedido\s+de|atendeu|atendid[oa]\s+por|respons[aá]vel:|titular:?|client[e]:?|sr\(a\)\.?|sra?\.|dr\(a\)\.|dra?\.|"
    r"pagador\s*[-:–]|benefici[aá]ri[oa]:?|favorecid[oa]:?|contratante:|locat[aá]ri[oa]:|locador[a]?:|paciente:?|alun[oa]:?|portador[a]?:?|nome:|combinado\s+com|recebi\s+de|"
    r"representad[oa]\s+por|senhor[a]?|procurador[a]?:|vendedor[a]?:|comprador[a]?:|eu,)\s+(?=[^\W\d_])",
    re.IGNORECASE,
)
#: What every introduction begins with, or holds after "em" and "a"; what every street begins with.
_STARTS = "assinad|atend|respons|titular|client|sr|dr|pagador|benef|favorecid|contratante:|locat|locador|paciente|alun|portador|nome:|combinado|recebi|representad|senhor|procurador|vendedor|comprador|eu,".split("|")
_SECOND = {"nome": re.compile(r"(?<!\w)em\s+$"), "pedido": re.compile(r"(?<!\w)a\s+$")}
_STREETS = "r.|rua|av|alameda|al.|trav|tv.|praça|pça|rodovia|rod.|estrada|largo|ladeira|viela|beco".split("|")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_GAP = re.compile(r"[ \t]*\n?[ \t]*(?=[^\W\d_])|,\s+(?=[^\W\d_])")
#: Two capitals or more, with links and commas between them.
_RUN = re.compile(r"[A-ZÀ-Ý][^\W\d_]*(?:['’][^\W\d_]+)?(?:(?:,? +|[ \t]*\n[ \t]*)(?:(?:d[aeo]s?|e)\s+)?[A-ZÀ-Ý][^\W\d_]*(?:['’][^\W\d_]+)?)+")


def _automaton() -> ahocorasick.Automaton:
    """The small-letter words where a street, an introduction or a name may begin, with what each is for."""
    words: dict[str, set[str]] = {}
    for what, own in (("street", _STREETS), ("intro", _STARTS), ("second", _SECOND), ("given", {v for w in GIVEN for v in (w, w.translate(_PLAIN))})):
        for w in own:
            words.setdefault(w, set()).add(what)
    out = ahocorasick.Automaton()
    for w, what in words.items():
        out.add_word(w, (len(w), w, what))
    out.make_automaton()
    return out


_AT_WORDS = _automaton()


class Redecoded(dict):
    """Word and page to what the page makes of it, remembered."""

    def __missing__(self, key: tuple[str, str]) -> str:
        if len(self) > 200_000:
            self.clear()
        out = self[key] = redecode(*key, "utf-8")
        return out


_REDECODED = Redecoded()
_BEFORE = re.compile(r"[\w@$-]+")
_ODD, _CHUNK, _SPACES = re.compile(ODD), re.compile(r"\S+"), re.compile(f"[{SPACES}]")
_GARBLED = re.compile("[ÃÂ├√┬Ð]")
_JOIN = re.compile(r"(?<=[^\W\d_])[-¬" + chr(0xAD) + r"][ \t]*\r?\n\s*(?=[a-zà-ÿ])")


def readable(text: str) -> str:
    """The form of a text that is searched."""
    if text.isascii():
        return _JOIN.sub("", text) if "\n" in text else text
    if _GARBLED.search(text):
        for _ in range(2):
            tries = [" ".join(w if w.isascii() else _REDECODED[w, wrong] for w in text.split(" ")) for wrong in ("cp1252", "cp850", "mac_roman")]
            new = min(tries, key=lambda t: sum(c > "~" for c in t))
            if sum(c > "~" for c in new) >= sum(c > "~" for c in text):
                break
            text = new
    if _ODD.search(text):
        text = _CHUNK.sub(lambda m: mapped_form(m[0]) if _ODD.search(m[0]) else m[0], _SPACES.sub(" ", text))
    return _JOIN.sub("", text) if "\n" in text else text


def before(text: str, at: int) -> list[str]:
    """Up to five words before a position, the nearest first, without accents."""
    return [plain(w) for w in _BEFORE.findall(text[max(0, at - 48) : at])[:-6:-1]]


def number_features(text: str, a: int, b: int, left: list[str]) -> list[str]:
    """Features of a span of digits that don't depend on its kind."""
    span = text[a:b]
    out = []
    for d, w in enumerate(left):
        if kind := _NEAR_PLAIN.get(w):
            out.append(f"near={kind}{min(d, 3)}")
            break
    else:
        out.append("near=none")
    if left and left[0].isdigit() and text[a - 1 : a] in (" ", "."):
        out.append("digits before")
    if re.match(r"[ .]\d", text[b : b + 2]):
        out.append("digits after")
    digits = re.sub(r"\D", "", span)
    out.append(f"size={len(digits)}")
    if digits.startswith(("0800", "0300", "0900", "4004", "08000")):
        out.append("toll free")
    out.append("shape=" + re.sub(r"\d+", lambda m: str(len(m[0])), re.sub(r"\s+", "_", span)))
    return out


_NEAR_PLAIN = {plain(w): k for w, k in _NEAR.items()}


def name_span(text: str, at: int) -> tuple[int, list[str]] | None:
    """The end and the words of a run of name-like words from ``at`` on."""
    words, end, lower = [], at, False
    pos = at
    while len(words) < 7:
        m = _NAME_WORD.match(text, pos)
        if not m or plain(m[0]) in _STOP:
            break
        w = m[0]
        link = w.lower() in _LINKS
        if not words:
            lower = w[0].islower()
        elif not link and w[0].islower() and not lower:
            break
        elif link and not words:
            break
        if lower and len(words) > 4:
            break
        words.append(w)
        if not link:
            end = m.end()
        gap = _GAP.match(text, m.end() + (len(w) == 1 and text[m.end() : m.end() + 1] == "."))
        if not gap:
            break
        if "\n" in gap[0] and sum(w.lower() not in _LINKS for w in words) > 1:
            break
        if "," in gap[0] and plain(_NAME_WORD.match(text, gap.end())[0]) not in _GIVEN:
            break  # a comma goes on only to a given name after the surname
        pos = gap.end()
    while words and words[-1].lower() in _LINKS:
        words.pop()
    return (end, words) if words else None


def mail_start(text: str, at: int) -> int:
    """Where the run of characters of a mail address's name begins that ends before ``at``, spaces aside."""
    at = len(text[:at].rstrip())
    m = _USER.search(text, max(0, at - LONGEST), at)
    return m.start() if m else at


def anchors(text: str) -> Iterator[tuple[int, str, str]]:
    """Start, word and purpose of every anchor of the automaton, in text order."""
    small = text.lower()
    if len(small) != len(text):  # a capital whose small form is longer: keep the positions
        small = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    found = [(end - size + 1, w, x) for end, (size, w, what) in _AT_WORDS.iter(small) for x in what]
    yield from sorted(found)


def introductions(text: str, spots: Iterable[tuple[int, str, str]] | None = None) -> list[re.Match]:
    """Matches of ``_INTRO`` in text order, tried only at the beginnings that its alternatives have."""
    starts = set()
    for at, word, what in anchors(text) if spots is None else spots:
        if what == "intro":
            starts.add(at)
        elif what == "second":
            begin = at
            while begin and text[begin - 1].isspace():
                begin -= 1
            if m := _SECOND[word].search(text.lower(), max(0, begin - 3), at):
                starts.add(m.start())
    out, last = [], 0
    for at in sorted(starts):
        if at >= last and (m := _INTRO.match(text, at)):
            out.append(m)
            last = m.end()
    return out


def candidates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Start, end, kind and features of every candidate segment."""
    out: list[tuple[int, int, str, list[str]]] = []
    spots = list(anchors(text))
    last = 0
    for sign in _MAIL_SIGN.finditer(text):
        if sign.start() >= last and (m := _MAIL.search(text, max(last, mail_start(text, sign.start())), sign.end() + LONGEST)):
            last = m.end()
            out.append((m.start(), m.end(), "email", ["at sign" if "@" in m[0] else "at word", "long" if len(m[0]) > 8 else "short"]))
    if "ponto" in text or "PONTO" in text or " dot " in text:
        for m in _SPELLED.finditer(text):
            out.append((m.start(), m.end(), "email", ["spelled", "dots" if len(re.findall(r"ponto|dot", m[0].lower())) > 1 else "dot"]))
    for run in _DIGITS.finditer(text):
        a, b = max(0, run.start() - 2), min(len(text), run.end() + 3)
        for pattern, kind, form in ((_PHONE, "telefone", "phone"), (_CPF, "identidade", "cpf"), (_RG, "identidade", "rg")):
            for m in pattern.finditer(text, a, b):
                f = number_features(text, m.start(), m.end(), before(text, m.start()))
                bare = m[0].isdigit() or m[0][:-2].isdigit()
                out.append((m.start(), m.end(), kind, [form, f"{form} {'bare' if bare else 'marked'} {f[0][:7]}", *f]))
        for m in _PASSPORT.finditer(text, run.start(), b):
            if letters := _LETTERS.search(text, max(0, m.start() - 4), m.start()):
                left = before(text, letters.start())
                out.append((letters.start(), m.end(), "identidade", ["passport", "named" if "passaporte" in left[:3] else "not named"]))
    for at, _, what in spots:
        if what == "street" and (m := _STREET.match(text, at)) and m.end() - m.start() <= LONGEST:
            out.append((m.start(), m.end(), "endereco", street_features(text, m)))
    return out + names(text, spots)


def street_features(text: str, m: re.Match) -> list[str]:
    """Features of a street with a number."""
    words = m[1].split()
    proper = [w for w in words if w.lower() not in _LINKS]
    f = ["street", "comma" if "," in m[2] or m[3] else "dash" if "-" in m[2] else "space", "number sign" if m[3] else "plain number"]
    f.append("no name" if not proper else "proper" if all(w[0].isupper() for w in proper) else "small")
    f.append("starts with link" if words and words[0].lower() in _LINKS else "starts without")
    f.append("home" if any(_NEAR_PLAIN.get(w) == "home" for w in before(text, m.start())[:4]) else "no home")
    f.append(f"words={min(4, len(proper))}")
    if re.match(r"\s*(?:de\s+(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)|[hHkK]|horas|folhas|litros|unidades)", text[m.end() : m.end() + 14]):
        f.append("date or measure")
    return f


def names(text: str, spots: list[tuple[int, str, str]]) -> list[tuple[int, int, str, list[str]]]:
    """The candidates for names: after introductions, from common given names on, and within runs of capitals."""
    spans: dict[tuple[int, int], list[str]] = {}
    for m in introductions(text, spots):
        for end, words in ends_of(text, m.end()):
            spans.setdefault((m.end(), end), ["intro", *name_features(text, m.end(), (end, words), True)])
    for run in _RUN.finditer(text):
        parts = [(x.start(), x.end(), x[0]) for x in _NAME_WORD.finditer(text, run.start(), run.end())]
        full = [i for i, x in enumerate(parts) if x[2].lower() not in _LINKS]
        for n, i in enumerate(full):
            for j in full[n + 1 : n + WORDS]:
                at, end = parts[i][0], parts[j][1]
                if end - at > LONGEST or chr(0xFFFD) in text[max(0, at - 4) : at]:
                    break  # too long, or the rest of a word that is lost
                words = [x[2] for x in parts[i : j + 1]]
                if (at, end) not in spans:
                    spans[at, end] = ["run", *name_features(text, at, (end, words), False), "cut left" if i else "whole left", "cut right" if j < full[-1] else "whole right"]
    for at, word, what in spots:
        edge = at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "@._")
        after = at + len(word)
        if what == "given" and edge and (after == len(text) or not text[after].isalnum()) and text[at:after] in (word, word.capitalize(), word.upper()):
            for end, words in ends_of(text, at):
                spans.setdefault((at, end), ["no intro", *name_features(text, at, (end, words), False)])
    return [(a, b, "nome", f) for (a, b), f in spans.items()]


def ends_of(text: str, at: int) -> list[tuple[int, list[str]]]:
    """Every end, and the words up to it, of a run of name-like words from ``at`` on."""
    found = name_span(text, at)
    if not found:
        return []
    out, words = [], []
    for m in _NAME_WORD.finditer(text, at, found[0]):
        words = [*words, m[0]]
        if m[0].lower() not in _LINKS:
            out.append((m.end(), words))
    return out


_NEXT_WORD = re.compile(r"[,.;:]?\s*([^\W\d_]+)")
_FIRM_END = re.compile(r",?\s+(?:S\.?A\b|S/A|Ltda|ME\b|EIRELI)", re.IGNORECASE)


def name_features(text: str, at: int, found: tuple[int, list[str]], introduced: bool) -> list[str]:
    """Features of a span of words: how many and of what kind, what stands before and after it."""
    end, words = found
    full = [w for w in words if w.lower() not in _LINKS]
    flat = [plain(w) for w in full]
    left = before(text, at)
    out = [f"words={min(4, len(full))}", "given first" if flat[0] in _GIVEN else "given inside" if any(w in _GIVEN for w in flat) else "no given"]
    how = "capital" if full[0][0].isupper() else "small"
    caps = len(full) > 1 and all(w.isupper() for w in full)
    out.append(("caps " + out[1]) if caps else how)
    if any(w in _FIRM for w in flat[:2]) or _FIRM_END.match(text, end):
        out.append("firm")
    if any(w in _FIRM for w in flat[2:]):
        out.append("firm inside")
    if any(w in _STOP for w in flat):
        out.append("stop inside")
    if left and left[0] in _FIRM or len(left) > 1 and left[0] in _LINKS and left[1] in _FIRM:
        out.append("firm before")
    if re.match(r"\s?@|\.\w", text[end : end + 2]) or text[at - 1 : at] in ("@", "_", ".", "-", "<"):
        out.append("in mail")
    if "," in text[at:end]:
        out.append("comma, given" if flat[-1] in _GIVEN or flat[1:2] and flat[1] in _GIVEN else "comma")
    if "\n" in text[at:end]:
        out.append("over lines")
    if introduced:
        out.append(f"intro {how} {out[1]}")
    if flat[-1] in _FIRM_LAST:
        out.append("firm last")
    if not introduced:
        gap = text[max(0, at - 3) : at].rstrip(" ")
        first = not gap or gap[-1] in ".;!?\n•-–|/("
        out.append(("start " if first else "inside ") + out[1])
        out.append("colon" if gap.endswith(":") else "no colon")
        if caps:
            out.append(f"loud {'start' if first else 'inside'} {out[1]}")
        if left and (left[0][-1].isdigit() or left[0] == "n" and "/n" in gap) and not first:
            out.append("after number")
        elif not first and left:
            out += [f"left={left[0]}", f"left={left[0]} {out[1]}"]
            if left[0] not in _SHORT:
                out.append(f"end={left[0][-3:]}")
                out.append("after article" if len(left) > 1 and left[1] in _ARTICLES else "no article")
            elif len(left) > 1:
                out.append(f"left2={left[1]}" if left[1] in _SHORT else f"end2={left[1][-3:]}")
        m = _NEXT_WORD.match(text, end)
        out.append("ends line" if text[end : end + 1] in ("", "\n") else "goes on" if m and m[1][0].islower() else "before capital" if m else "before other")
    return out


_FIRM_LAST = {"ltda", "me", "eireli", "sa", "s", "cia"}
_ARTICLES = {"o", "a", "os", "as", "do", "da", "ao", "pelo", "pela", "um", "uma"}
#: Words that stand for themselves; of longer ones before a name the ending tells what they are.
_SHORT = {*_ARTICLES, *"de em no na nos nas por para com e que foi era como sob sem entre ate dos das aos".split()}


class SemiCRF:
    """Weights of (kind, feature) and of (kind before, kind), and the best segmentation."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, kind: str, features: list[str]) -> float:
        w = self.weights
        return w.get((kind, ""), 0.0) + sum(w.get((kind, f), 0.0) for f in features)

    def step(self, kind: str, before: str | None) -> float:
        """The weight of a segment of ``kind`` that follows one of ``before``; None for the first."""
        return self.weights.get((kind, f"after {before}"), 0.0)

    def fit(self, data: list[tuple[list, set]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Gradient steps on the conditional log likelihood; ``data`` has candidates and the true (start, end, kind)."""
        order = list(range(len(data)))
        rng = random.Random(7)
        for step in range(rounds):
            rng.shuffle(order)
            size = rate / (1 + step) ** 0.5
            for i in order:
                spans, true = data[i]
                each, steps = self.expected(spans)
                change: dict[tuple[str, str], float] = {k: -v for k, v in steps.items()}
                last = None
                for _, _, kind in sorted(true):
                    change[kind, f"after {last}"] = change.get((kind, f"after {last}"), 0.0) + 1
                    last = kind
                for (a, b, kind, features), p in zip(spans, each, strict=True):
                    g = ((a, b, kind) in true) - p
                    if abs(g) > 1e-3:
                        for f in ["", *features]:
                            change[kind, f] = change.get((kind, f), 0.0) + g
                for k, g in change.items():
                    if abs(g) > 1e-3:
                        w = self.weights.get(k, 0.0)
                        self.weights[k] = w + size * (g - decay * w)

    def marginals(self, spans: list) -> list[float]:
        """Probability of each candidate, summed over all segmentations."""
        return self.expected(spans)[0]

    def expected(self, spans: list) -> tuple[list[float], dict[tuple[str, str], float]]:
        """Probability of each candidate, and expected number of each transition, over all segmentations."""
        order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
        ends, kinds = [spans[i][1] for i in order], [spans[i][2] for i in order]
        scores = [self.score(spans[i][2], spans[i][3]) for i in order]
        last = [bisect_right(ends, spans[i][0]) for i in order]
        known = sorted(set(kinds))
        # ahead[k][j]: all segmentations of the first j candidates that end in one of kind k
        ahead: dict[str, list[float]] = {k: [-math.inf] for k in known}
        alpha, total = [], 0.0
        for j, kind in enumerate(kinds):
            sums = self.step(kind, None)
            for k in known:
                sums = log_add(sums, ahead[k][last[j]] + self.step(kind, k))
            alpha.append(sums + scores[j])
            total = log_add(total, alpha[j])
            for k in known:
                ahead[k].append(log_add(ahead[k][j], alpha[j]) if k == kind else ahead[k][j])
        started = sorted(range(len(order)), key=lambda j: spans[order[j]][0])
        starts = [spans[order[j]][0] for j in started]
        behind: dict[str, list[float]] = {k: [-math.inf] * (len(order) + 1) for k in known}
        beta = [0.0] * len(order)
        for r in range(len(order) - 1, -1, -1):
            j = started[r]
            after = bisect_left(starts, ends[j])
            after = max(after, r + 1)
            sums = 0.0
            for k in known:
                sums = log_add(sums, behind[k][after] + self.step(k, kinds[j]))
            beta[j] = sums
            for k in known:
                behind[k][r] = log_add(behind[k][r + 1], scores[j] + beta[j]) if k == kinds[j] else behind[k][r + 1]
        each, steps = [0.0] * len(spans), {}
        for j, i in enumerate(order):
            each[i] = math.exp(min(0.0, alpha[j] + beta[j] - total))
            rest = scores[j] + beta[j] - total
            for k in (None, *known):
                x = (0.0 if k is None else ahead[k][last[j]]) + self.step(kinds[j], k) + rest
                if x > -20:
                    at = kinds[j], f"after {k}"
                    steps[at] = steps.get(at, 0.0) + math.exp(x)
        return each, steps

    def best(self, spans: list) -> list[tuple[int, int, str]]:
        """The segments of the best segmentation, in text order."""
        if not spans:
            return []
        kinds = {x[2] for x in spans}
        # a segment changes three transitions at most: what is worse than these can't be in the best segmentation
        least = -3 * max(abs(self.step(k, before)) for k in kinds for before in (None, *kinds))
        scored = sorted((b, a, kind, s) for a, b, kind, f in spans if (s := self.score(kind, f)) >= least)
        ends = [x[0] for x in scored]
        # best total of the first j candidates by their last kind, and the candidate it ends with
        tops: list[dict[str | None, tuple[float, int]]] = [{None: (0.0, -1)}]
        back: list[tuple[float, str | None, int]] = []
        for j, (_, a, kind, s) in enumerate(scored):
            m = bisect_right(ends, a, 0, j)
            total, before = max(((t + self.step(kind, k), k) for k, (t, _) in tops[m].items()), key=lambda x: x[0])
            back.append((total + s, before, m))
            now = tops[-1]
            if kind not in now or total + s > now[kind][0]:
                now = now | {kind: (total + s, j)}
            tops.append(now)
        out = []
        _, j = max(tops[-1].values(), key=lambda x: x[0])
        while j >= 0:
            _, before, m = back[j]
            out.append((scored[j][1], scored[j][0], scored[j][2]))
            j = tops[m][before][1]
        return out[::-1]


def log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    if b == -math.inf:
        return a
    return a + math.log1p(math.exp(b - a))


def examples(count: int = 2_400, seed: int = 11) -> list[tuple[str, set]]:
    """Labelled sentences of a small grammar: text and its (start, end, kind)."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    syllable = lambda: pick("bcdfglmnprstv") + pick(["", "", "r", "l"]) + pick("aeiouáéíó") + pick(["", "", "n", "r", "l"])
    surname = lambda: ("".join(syllable() for _ in range(rng.randint(2, 3))) + pick(["a", "o", "es", "eira"])).capitalize()
    given = lambda: pick(GIVEN).capitalize() if rng.random() < 0.5 else surname()

    def full_name() -> str:
        """Two words or more in capitals."""
        own = [given() for _ in range(rng.choice([1, 1, 2]))]
        last = [surname() for _ in range(rng.choice([1, 1, 2]))]
        name = re.sub(" +", " ", " ".join(own) + " " + pick([" ", " ", " da ", " de "]).join(last))
        return name.replace(" ", "\n", 1) if rng.random() < 0.05 else name

    def person() -> str:
        """A name as it follows an introduction."""
        own = [given() for _ in range(rng.choice([1, 1, 2]))]
        last = [surname() for _ in range(rng.choice([1, 1, 2]))]
        if rng.random() < 0.25:
            return f"{pick([' ', ' da ', ' de ']).join(last)}, {' '.join([pick(GIVEN).capitalize(), *own[1:]])}"
        name = full_name()
        return pick([name, name, name, name.lower(), name.upper()])

    def phone() -> str:
        area, a, b = pick("123456789") + digits(1), pick(["9" + digits(4), digits(4)]), digits(4)
        return pick([f"({area}) {a}-{b}", f"({area}){a}-{b}", f"+55 {area} {a}-{b}", f"+55{area}{a}{b}", f"{area}.{a}.{b}", f"{area} {a}{b}", f"0{area} {digits(4)} {b}", f"({area}) 9 {digits(4)} {b}", f"{area} {a}-{b}", f"{digits(4)}-{b}", f"9{digits(4)}-{b}"])

    def cpf() -> str:
        a = [digits(3), digits(3), digits(3)]
        return pick([".".join(a) + "-" + digits(2), " ".join([*a, digits(2)]), "".join(a) + digits(2), "".join(a) + "-" + digits(2)])

    def rg() -> str:
        return pick([f"{digits(2)}.{digits(3)}.{digits(3)}-{pick('0123456789X')}", digits(9), digits(8) + "-" + digits(1)])

    def street() -> str:
        kind = pick(["Rua", "R.", "Avenida", "Av.", "Alameda", "Travessa", "rua", "Praça", "Estrada", "Rodovia"])
        name = pick([pick(["das ", "dos ", "da ", "de ", ""]) + surname(), f"{pick(GIVEN).capitalize()} {surname()}"])
        number = pick([f", {digits(rng.randint(1, 4)).lstrip('0') or '7'}", f" {digits(3).lstrip('0') or '8'}", f", nº {digits(3).lstrip('0') or '9'}", ", s/n", f", n. {pick('123456789')}{digits(1)}"])
        return pick([kind, kind, kind.lower(), kind.upper()]) + " " + name + number

    def mail() -> str:
        user = plain(pick(GIVEN)) + pick([".", "_", "-", ""]) + plain(surname()) + pick(["", "", digits(2)])
        host, end = pick(["correio", "caixa", "posta", "exemplo"]), pick(["com", "org", "net", "com.br"])
        out = pick([f"{user}@{host}.{end}", f"{user} (arroba) {host}.{end}", f"{user} [at] {host} [ponto] {end}", f"{user} @ {host}.{end}", f"{user}+contas@{host}.{end}"])
        return pick([out, out, out.upper()])

    firm = lambda: pick(["Instituto", "Hospital", "Fundação", "Escola", "Colégio", "Grupo", "Casa", "Comercial", "Cooperativa"]) + " " + pick([surname(), f"{pick(GIVEN).capitalize()} {surname()}"])
    roles = ("locatário", "inquilina", "morador", "diretor", "gerente", "síndico", "motorista", "professora", "vizinha", "advogado", "contador", "cliente", "funcionária", "médica")
    place = lambda: pick(["Porto", "Nova", "São", "Barra do", "Santa", "Campo", "Vale", "Serra"]) + " " + pick([surname(), given(), f"{given()} do {surname()}"])
    stem = lambda: "".join(pick("bcdfglmnprstv") + pick("aeiou") for _ in range(rng.randint(1, 3)))
    role = lambda: pick(roles) if rng.random() < 0.3 else stem() + pick(["eiro", "eira", "ista", "dor", "dora", "tor", "tora", "ário", "ária", "ino", "ina", "ente", "ona", "ogo", "oga"])
    deed = lambda: pick(deeds) if rng.random() < 0.3 else stem() + pick(["ou", "eu", "iu"])
    thing = lambda: stem() + pick(["ção", "dade", "mento", "agem", "to", "ta", "ça", "ço", "nho", "al", "el", "eto", "so"])
    deeds = ("recebeu", "assinou", "ligou", "pediu", "retirou", "entregou", "avisou", "confirmou", "respondeu")
    good = (
        (lambda: pick(["Assinado por ", "em nome de ", "a pedido de ", "Atendeu ", "Responsável: ", "Titular: ", "Cliente ", "Sr(a). ", "Pagador - ", "Paciente: ", "Nome: ", "Senhora ", "Dr. "]), person, "nome", ("", " no balcão", ".", ", o prazo mudou")),
        (lambda: pick(["O recibo é de ", "A carta de ", "Veio ", "Falei com ", "Conversei com ", "A visita foi feita por ", "O pacote foi entregue a ", "Segundo ", "Procurar "]), full_name, "nome", (" ontem", ".", " na portaria", " pela manhã", ", que assinou")),
        (lambda: f"{pick(['como', 'segundo', 'conforme', 'hoje', 'ontem', 'aqui', ''])} {deed()} {pick(['', 'o ', 'a ', 'para ', 'com ', 'por '])}", full_name, "nome", ("", ".", " no portão", ", da rua de cima")),
        (lambda: f"{pick(['ficou', 'veio', 'saiu', 'a cópia', 'o envelope', stem() + 'ado', stem() + 'ida', thing()])} {pick(['com', 'para', 'por', 'a'])} ", full_name, "nome", ("", ".", " na recepção", f" em {digits(2)}/05")),
        (lambda: f"{pick(['o', 'a'])} {role()}, ", full_name, "nome", (f", {deed()}", ",")),
        (lambda: f"{pick(['Quem', 'Foi ela que', 'A pessoa que'])} {deed()} {pick(['foi', 'era', 'é'])} {pick(['o ', 'a ', ''])}", full_name, "nome", ("", ".", " na entrada", " hoje")),
        (lambda: f"{pick(['o', 'a', 'do', 'da', 'ao', 'pelo', 'pela', 'um', ''])} {role()} ", full_name, "nome", (f" {deed()}", ".", "", " mora aqui", f", {deed()} ontem")),
        (lambda: f"{role().capitalize()}{pick([' ', ': ', ' final ', ' principal ', ' anterior '])}", full_name, "nome", ("", ".", f" {deed()} tudo")),
        (lambda: pick(["Tel.: ", "Telefone ", "Fone ", "cel. ", "WhatsApp ", "Ligar para ", "Recados em ", "pelo número ", "Contato: "]), phone, "telefone", ("", " (à noite)", ".", " ramal 12")),
        (lambda: "Chamar em ", lambda: pick([f"({pick('123456789')}{digits(1)}) {digits(4)}-{digits(4)}", f"+55 {pick('123456789')}{digits(1)} 9{digits(4)}-{digits(4)}"]), "telefone", ("", ".")),
        (lambda: pick(["CPF ", "CPF nº ", "cpf: ", "CPF do titular ", "inscrição no CPF ", "documento "]), cpf, "identidade", ("", ".", " A tarifa")),
        (lambda: "O interessado ", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}-{digits(2)}", "identidade", ("", ".")),
        (lambda: pick(["RG ", "Identidade nº ", "carteira de identidade ", "RG: "]), rg, "identidade", ("", ".")),
        (lambda: pick(["CNH ", "Registro CNH ", "habilitação nº "]), lambda: digits(11), "identidade", ("", ".")),
        (lambda: pick(["Passaporte ", "passaporte nº "]), lambda: pick("ABCFGXYZ") + pick("ABKQWVXY") + digits(6), "identidade", ("", ".")),
        (lambda: pick(["Endereço: ", "Residência: ", "mora na ", "Entrega em ", "Imóvel situado à ", "Mandar para ", ""]), street, "endereco", ("", ", apto 12", " - Centro", ", casa 2", f", casa 2, {surname()} das {surname()}, CEP 12345-678", f", fundos, {surname()} {surname()} - CEP 12345-678", f", {surname()} {pick(['das', 'do', 'dos', ''])} {surname()}".replace("  ", " "), f", {place()}")),
        (lambda: pick(["E-mail ", "Contato: ", "Responder em ", "", "cópia para "]), mail, "email", ("", " até sexta")),
        (lambda: pick(["E-mail ", "Contato: ", "escrever a "]), lambda: f"{plain(pick(GIVEN))} {pick(['em', 'arroba'])} {pick(['correio', 'caixa', 'posta'])} ponto {pick(['com', 'org', 'net'])}", "email", ("", ".", " hoje")),
    )
    small = lambda: pick(["rede", "tarifa", "multa", "cópia", "conta"])
    heading = lambda: " ".join(pick(["Conta", "Nota", "Recibo", "Contrato", "Ficha", "Aviso", "Fatura", "Comunicado", "Relatório", "Demonstrativo", "Cópia", "Ofício", "Termo"]) if i % 2 == 0 else pick(["Fiscal", "Mensal", "Geral", "Anual", "de Serviço", "de Pagamento", "do Arquivo", "Interno"]) for i in range(2))
    words = "a o da no uma pela conta tarifa prazo setor leitura agência energia água exame aula contrato alterou manteve depois sem entrega média geral ponte estrada ônibus consulta registro nível máquina".split()
    line = lambda: " ".join(pick(words) for _ in range(rng.randint(3, 8)))
    bad = (
        lambda: line().upper(),
        lambda: f"{surname()} {pick(['S.A.', 'Ltda', ''])} {pick(['::', '-', '|'])} {pick(words)} {pick(words)}".upper(),
        lambda: f"{pick(['Fornecedor', 'Emitente', 'Contratada', 'Titular', 'Cedente'])}: {pick([surname(), f'{surname()} {surname()}', firm()])} {pick(['Ltda', 'S.A.', 'ME', 'EIRELI'])}",
        lambda: f"{heading()} {pick(['-', '::', '|'])} {heading()}".upper(),
        lambda: f"{pick(['Aviso', 'Conta', 'Nota'])} de {pick(words).capitalize()} {pick(['do', 'e', 'de'])} {pick(words).capitalize()}".upper(),
        lambda: f"o {pick(['prontuário do paciente', 'direito do portador', 'cadastro do cliente', 'aviso do titular', 'caderno do aluno'])} {pick(['dentro do prazo', 'ao fim do período', 'sem custo', 'de acordo com a regra', 'com ' + line(), line()])}",
        lambda: f"{pick(['casa 2', 'apto 31', 'fundos', 'lote 9'])}, {surname()} {pick(['das', 'do', 'dos', ''])} {surname()}, CEP {digits(5)}-{digits(3)}".replace("  ", " "),
        lambda: f"{pick(['bloco C', 'setor'])} {pick('ABCD')}, {surname()} {surname()}, CEP",
        lambda: f"com protocolo {digits(rng.randint(9, 12))} na {small()}",
        lambda: f"Chave de acesso {' '.join(digits(4) for _ in range(11))}",
        lambda: f"Linha digitável {digits(5)}.{digits(5)} {digits(5)}.{digits(6)} {digits(5)}.{digits(6)} {digits(1)} {digits(14)}",
        lambda: f"{pick(['Unidade', 'Instalação', 'Matrícula', 'Série', 'Lote'])} {digits(8)}-{digits(1)}",
        lambda: f"{pick(['Atendimento', 'Ouvidoria', 'Ligação gratuita', 'Central'])} {pick(['0800', '0300', '4004'])} {digits(3)} {digits(4)}",
        lambda: f"CNPJ {digits(2)}.{digits(3)}.{digits(3)}/{digits(4)}-{digits(2)}",
        lambda: f"Processo {digits(7)}-{digits(2)}.{digits(4)}.8.26.{digits(4)}",
        lambda: f"{pick(['de registro', 'com o registro', 'no registro', 'número de controle'])} {digits(rng.randint(4, 9))} da {small()}",
        lambda: f"Protocolo de atendimento {digits(11)}",
        lambda: f"Código do item {pick('ABCDE')}{digits(6)} e {pick('AB')}{pick('CD')}{digits(6)}",
        lambda: f"Matrícula do imóvel {digits(3)}.{digits(3)} - livro 2",
        lambda: f"{pick(['Encaminhado ao', 'Entregue à', 'Enviado para', 'Comprado na', 'Convênio com'])} {firm()} para arquivo.",
        lambda: f"Titular: {firm()} Ltda",
        lambda: f"da empresa {firm()} no valor de R$ {digits(3)},{digits(2)}",
        lambda: f"da empresa {surname()} {pick(['Ltda', 'S.A.', 'ME'])} {pick(['alterou', 'manteve'])} a {small()}",
        lambda: f"{pick([surname(), full_name()])} {pick(['Ltda', 'S.A.', 'ME'])} - {heading()}",
        lambda: f"{firm()} - {heading()}",
        lambda: pick([heading(), heading().upper(), f"{firm()} ME".upper()]),
        lambda: f"{pick(['em', 'no', 'na', 'de', 'para', 'à'])} {place()}{pick(['.', ' por causa da chuva', ' alterou a tarifa'])}",
        lambda: f"{pick(['bairro', 'cidade de', 'comarca de', 'município de', 'bloco C -', 'centro -'])} {pick([place(), f'{surname()} {surname()}', f'Vila {surname()}', f'Parque dos {surname()}', f'Jardim {surname()} {surname()}'])}",
        lambda: f"{pick(['o', 'a', 'do', 'da', 'uma', 'no', 'na'])} {thing()} {pick([place(), f'{surname()} {surname()}'])} {deed()}",
        lambda: f"{thing()} {pick(['em', 'de', 'da', 'do', 'no', 'na', 'para'])} {place()} {deed()} a {thing()}",
        lambda: f"{deed()} {pick(['em', 'no', 'na', 'até', 'a', 'o'])} {pick([place(), firm()])}",
        lambda: f"{deed()} a {small()} da empresa {pick([f'{surname()} {surname()}', firm()])}",
        lambda: f"{pick(['vinho', 'produto', 'modelo', 'hotel', 'serviço prestado no', 'projeto', 'edital'])} {surname()} {surname()}",
        lambda: f"{pick(['A', 'O', 'Na', 'Esta'])} {pick(['Marca', 'Linha', 'Peça', 'Loja'])} {surname()} {pick(['foi trocada', 'mudou'])}",
        lambda: f"Marca {surname()} e Linha {surname()} em promoção",
        lambda: f"{pick(['Importância', 'Valor', 'Total'])} de R$ {digits(3)},{digits(2)} Emissão {digits(2)}/{digits(2)}/20{digits(2)}",
        lambda: f"A feira da Rua das {surname()} foi adiada.",
        lambda: f"rede de esgoto da travessa {pick(['de 9 de setembro', 'com 123 peças', 'com 340 horas', 'do lote 12', 'no dia 14'])}",
        lambda: f"Havia obras na rua principal e na avenida do mercado {pick(['12 vezes', ''])}",
        lambda: f"a pedido {pick(['do responsável', 'da gerência'])}, o prazo mudou",
        lambda: f"Cliente {pick(['desde', 'com', 'sem'])} {small()} em atraso",
        lambda: f"{pick(roles).capitalize()} {pick(['atual', 'anterior', 'novo'])} da {pick(['Rua', 'Praça', 'Vila'])} {surname()} {pick(deeds)} a {small()}",
        lambda: f"{digits(2)} itens @ R$ {digits(2)},{digits(2)} cada",
        lambda: f"Data {digits(2)}/{digits(2)}/20{digits(2)} Valor R$ {digits(3)},{digits(2)} em 20{digits(2)}-0{pick('123456789')}-1{digits(1)}",
        lambda: f"em Porto {surname()} e São {pick(GIVEN).capitalize()} do {surname()}",
        lambda: f"conta {digits(4)} {digits(4)} agência {digits(4)}",
        lambda: f"CEP {digits(5)}-{digits(3)}",
        lambda: f"{pick(['bloco C', 'apto 12', 'fundos', surname()])} - {digits(8)}",
        lambda: f"{small()} {digits(rng.randint(7, 11))} {small()}",
    )
    out = []
    for _ in range(count):
        text, true = "", set()
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.55:
                intro, make, kind, after = pick(good)
                lead, span = intro(), make()
                text += lead
                true.add((len(text), len(text) + len(span), kind))
                text += span + pick(after)
            else:
                text += pick(bad)() if rng.random() > 0.12 else pick(bad)().upper()
            text += pick([". ", "\n", " "])
        out.append((text, true))
    return out


def trained() -> SemiCRF:
    """The model fitted to the grammar's sentences; a true span that no candidate has is taken as its best overlap."""
    data = []
    for text, true in examples():
        spans = candidates(text)
        keys = {(a, b, k) for a, b, k, _ in spans}
        own = set()
        for a, b, k in true:
            near = [x for x in keys if x[2] == k and x[0] < b and a < x[1]]
            if near:
                own.add(max(near, key=lambda x: (min(b, x[1]) - max(a, x[0]) - abs(x[0] - a) - abs(x[1] - b), -x[0])))
        data.append((spans, own))
    model = SemiCRF()
    model.fit(data)
    return model


def run_over(spark: SparkSession, df: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``tipos`` and ``texto`` with placeholders, of every row with any personal information."""
    shared = spark.sparkContext.broadcast(trained())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in batches:
            keep, kinds, texts = [], [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                t = readable(t)
                if found := model.best(candidates(t)):
                    out, last = [], 0
                    for a, b, k in found:
                        out += [t[last:a], f"[{k.upper()}]"]
                        last = b
                    keep.append(i)
                    kinds.append(sorted({k for _, _, k in found}))
                    texts.append("".join(out) + t[last:])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int32())), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["id", "tipos", "texto"])

    rows = df.select(key, text).where(F.length(F.trim(F.col(text))) > 0)
    return rows.mapInArrow(run, f"id {kind}, tipos array<string>, texto string")


def found(spark: SparkSession, df: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """``id`` and ``tipo`` of the kinds in each text."""
    return run_over(spark, df, key, text).select("id", F.explode("tipos").alias("tipo")).distinct()


def masked(spark: SparkSession, df: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """``id``, ``tipos`` and ``mascarado``: the texts that hold personal information, with typed placeholders."""
    return run_over(spark, df, key, text).select("id", "tipos", F.col("texto").alias("mascarado"))
