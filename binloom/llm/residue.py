"""Template residue and error-page text (problem 8).

One multi-pattern automaton finds phrases of error, block and check pages, of
notices that scripts or cookies are needed, of page furniture, of failing
programs and of filler, in several languages; a word for scripts and a word for
what has to be done with them, or a stand-in and what goes here, count with all
that stands between them. A sentence
of whose letters matches make up a good part counts as covered, however long it
is; words with digits, such as references, do not count at all, and a sentence in
which the author tells what they did is not covered unless it is nothing but
phrases. Pseudo-Latin, a word repeated over and over, and runs over the keys have
no phrases and count as covered by their words. A text is residue when what is
covered makes up most of it, or most of its body under a title. Unfilled
placeholders and printed missing values are residue wherever the author's own
prose has them.

Code, quotations and quoted lines are what a post talks about: they are never
covered, and code and quotations count as text that is not.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.session import spread

#: Part of a text, or of its body, that has to be covered.
COVERED = 0.6
#: Part of a sentence's letters that matches have to make up.
SENTENCE = 0.3
#: Part of them in a sentence that tells what somebody did.
TOLD = 0.75
#: Characters between a word for scripts and what has to be done with them, or between a stand-in and where it goes.
REACH = 40

# Phrases, lower case, without accents and with single blanks.
ERRORS = (
    "error", "not found", "page not found", "bad request", "unauthorized", "forbidden", "gone", "request timeout",
    "too many requests", "internal server error", "bad gateway", "service unavailable", "gateway timeout", "gateway time-out",
    "access denied", "permission denied", "oops", "whoops", "could not be found", "cannot be found", "can't be found", "page can't", "isn't available", "is unavailable", "content cannot be shown", "not available in your", "in your region", "in your country", "temporarily unavailable", "this site", "work properly", "turn it on and reload", "and reload",
    "the page you were looking for", "the page you are looking for", "the page you requested", "page does not exist", "page doesn't exist",
    "no longer available", "no longer exists", "moved or deleted", "been removed", "been deleted", "do not have permission", "don't have permission", "to open this resource",
    "to view this page", "to access this", "not authorized", "not allowed to", "down for maintenance", "under maintenance", "be back soon",
    "something went wrong", "went wrong on our side", "an error occurred", "error occurred", "an unexpected error", "while rendering this", "try again in a few", "please try again", "try again later",
    "took too long to answer", "took too long to respond", "timed out", "connection timed out", "could not connect to", "unable to connect", "connect to the database",
    "error establishing a database connection", "session expired", "session has expired", "sign in once more", "sign in again", "log in again", "please log in", "requests from your address", "rate limit exceeded",
    "from your network", "unusual traffic", "was denied", "by a security rule", "you have been blocked", "has been blocked", "are you a robot", "are you human", "not a robot", "tick the box", "verify you are",
    "checking your browser", "before the page opens", "just a moment", "one moment please", "complete the captcha", "solve the captcha", "security check", "security service", "performing security",
    "request id", "reference number", "incident id", "ray id", "diese seite existiert nicht", "seite nicht gefunden", "seite wurde nicht gefunden", "nicht gefunden werden", "konnte nicht gefunden", "zugriff verweigert", "interner serverfehler",
    "ein fehler ist aufgetreten", "etwas ist schiefgelaufen", "spater erneut", "versuchen sie es", "wartungsarbeiten", "sitzung ist abgelaufen", "sitzung abgelaufen", "keine berechtigung", "nicht erreichbar", "nicht verfugbar",
    "un probleme est survenu", "une erreur est survenue", "une erreur s'est produite", "reessayez plus tard", "page introuvable", "est introuvable", "page n'existe pas", "n'existe plus", "acces refuse", "acces interdit", "en maintenance", "session a expire", "session expiree", "erreur interne",
    "no hemos encontrado", "no se ha encontrado", "no se encontro", "pagina no encontrada", "pagina no existe", "lo sentimos", "acceso denegado", "ha ocurrido un error", "se ha producido un error", "algo salio mal", "intentalo de nuevo", "vuelva a intentarlo", "en mantenimiento", "sesion ha caducado", "sesion ha expirado", "error interno",
    "pagina nao encontrada", "nao foi possivel encontrar", "nao foi encontrada", "acesso negado", "ocorreu um erro", "tente novamente", "algo deu errado", "em manutencao", "sua sessao expirou",
    "pagina non trovata", "accesso negato", "si e verificato un errore", "riprova piu tardi", "qualcosa e andato storto", "in manutenzione",
    "pagina niet gevonden", "niet gevonden", "toegang geweigerd", "er is een fout opgetreden", "er ging iets mis", "er is iets misgegaan", "probeer het later", "bestaat niet",
    "nie znaleziono", "strona nie istnieje", "odmowa dostepu", "wystapil blad", "sidan kunde inte hittas", "siden blev ikke fundet", "sayfa bulunamadi", "bir hata olustu",
    "страница не наидена", "не наидена", "не наидено", "не существует", "доступ запрещен", "доступ запрещён", "произошла ошибка", "что-то пошло не так", "попробуите позже", "попробуите еще раз", "повторите попытку", "технические работы", "сессия истекла", "ошибка сервера", "внутренняя ошибка",
    "ページか見つかりません", "見つかりません", "見つかりませんてした", "アクセスか拒否", "エラーか発生", "メンテナンス中", "しはらくしてから", "もう一度お試し", "セッション", "找不到", "页面不存在", "访问被拒绝", "发生错误", "服务器错误", "请稍后", "维护中", "頁面不存在", "페이지를 찾을 수", "접근이 거부", "오류가 발생",
)
SCRIPTS = (
    "enable javascript", "enable js", "javascript is required", "js is required", "javascript is disabled", "javascript to view", "to display this content", "to view this page", "turn on javascript", "activate javascript", "requires javascript", "need javascript",
    "needs javascript", "javascript must be", "js must be", "switch on scripts", "scripts in your browser", "scripts are blocked", "scripts are disabled", "after allowing them", "scripting turned off", "parts cannot be shown", "enable scripts", "allow scripts", "enable cookies", "allow cookies", "cookies are disabled", "cookies are required", "cookies and javascript", "cookies and js", "javascript and cookies", "must be allowed", "must be enabled", "before this discussion can load", "your browser has", "your browser does not support", "in your browser to continue",
    "aktivieren sie javascript", "aktivieren sie js", "um diese seite anzuzeigen", "javascript aktivieren", "javascript ist deaktiviert", "werden skripte benotigt", "fur diese ansicht", "cookies aktivieren", "aktivieren sie cookies", "benotigt javascript", "skripte zulassen",
    "activer javascript", "activer js", "pour afficher cette page", "activez javascript", "javascript est desactive", "javascript est necessaire", "activer les cookies", "necessite javascript", "scripts sont bloques",
    "active javascript", "active js", "en su navegador", "para ver el contenido", "habilite javascript", "activar javascript", "habilitar javascript", "activa javascript", "javascript esta desactivado", "requiere javascript", "habilite las cookies", "activar las cookies",
    "ative o javascript", "ative o js", "para continuar", "ativar javascript", "habilite o javascript", "javascript desativado", "attiva javascript", "abilita javascript", "abilitare javascript", "attivare javascript", "per visualizzare questa pagina",
    "schakel javascript in", "schakel js in", "om verder te gaan", "javascript inschakelen", "zet javascript aan", "wlacz javascript", "wlacz obsluge javascript", "aktivera javascript", "aktiver javascript", "slå på javascript", "javascript'i etkinlestir",
    "включите javascript", "включите js", "включить javascript", "необходим javascript", "требуется javascript", "javascript отключен", "в вашем браузере", "включите cookie", "чтобы продолжить", "для просмотра", "javascriptを有効", "jsを有効", "javascriptか無効", "jsか無効", "有効にしてくたさい", "このペーシを表示するには", "このヘーシを表示", "启用javascript", "启用 javascript", "请启用", "啟用javascript", "javascript를 활성화", "자바스크립트를",
)
FURNITURE = (
    "go back to the home page", "back to the home page", "back to home", "skip to content", "skip to main content", "loading", "please wait", "home questions tags users", "search", "contact", "contact us", "contact support", "<noscript>", "ref.",
)
FILLER = (
    "lorem ipsum", "dolor sit amet", "goes here", "replace before publishing", "replace this text", "sample text", "dummy text", "filler text", "placeholder text", "example text", "answer text", "your text here", "text goes here", "insert text", "insert your", "does this show up", "just testing", "this is a test", "test post", "please ignore", "1 2 3 test", "test test", "testing testing", "blindtext", "texte ici", "texte provisoire", "a remplacer", "faux texte", "texte de remplissage", "mustertext", "fülltext", "texto de relleno", "texto provisional", "texto de muestra", "texto provisorio", "testo segnaposto", "testo di prova", "voorbeeldtekst", "opvultekst", "tekst zastępczy", "текст-заполнитель", "пример текста", "ダミーテキスト", "サンプルテキスト", "示例文本", "占位文本", "texto de ejemplo", "texto de prueba", "texte d'exemple", "beispieltext", "platzhaltertext", "content coming soon", "coming soon", "to be written", "to be added", "write something here", "type here",
)
#: Pseudo-Latin is made of these.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse "
    "cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
_SYLLABLES = re.compile(r"(?:lo|rem|ip|sum|do|lor|sit|am|et|con|sec|te|tur|ad|pi|scing|el|it|sed|eius|mod|por|in|ci|di|dunt|ut|la|bo|re|mag|na|ali|qua)+$")
_KEYS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "asdfghjklö", "qsdfghjklm", "zxcvbnm", "yxcvbnm", "wxcvbn", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю", "1234567890")
_RUNS = frozenset(row[i:j] for k in _KEYS for row in (k, k[::-1]) for i in range(len(row)) for j in range(i + 3, len(row) + 1))
#: More pages in other words.
PAGES = (
    "this page", "could not locate", "could not find", "couldn't find", "can't find", "that page", "you asked for", "may have moved", "might have been removed", "may have been moved", "try searching", "page is missing", "currently unavailable", "reload the page", "refresh the page", "return to the homepage", "go to the homepage", 
    "la pagina que", "que buscas", "ha desaparecido", "vuelve al inicio", "volver al inicio", "no esta disponible", "no se puede mostrar", "la page que", "vous cherchez", "vous recherchez", "a disparu", "retour a l'accueil", "n'est pas disponible", "indisponible", "desole", "nicht zur verfugung", "derzeit leider", "diese seite", "die seite", "die gesuchte", "zuruck zur startseite", "zur startseite", "existiert nicht", "wurde verschoben", "non e disponibile", "non disponibile", "torna alla home", "nao esta disponivel", "voltar ao inicio", "deze pagina", "niet beschikbaar", "niedostepna", "недоступна", "вернуться на главную",
    "powered by", "protected by", "secured by", "hosted by", "ray", "ref", "event id", "error code", 
)
#: What failing programs print into pages.
DUMPS = (
    "warning:", "notice:", "deprecated:", "fatal error:", "parse error:", "syntax error:", "php warning:", "php notice:", "php fatal error:", "type error:", "typeerror:", "value error:", "valueerror:", "keyerror:", "nameerror:", "runtime error:", "database error:", "script error:", "template error:", "application error:", "server error:", "sql error:", "uncaught exception", "uncaught error", "unhandled exception", "stack trace", "traceback", "on line", "in /var/", "in /srv/", "in /home/", "in /usr/", "in /app/", "in /opt/", "/var/www/", "/srv/app/",
    "cannot modify header information", "cannot send headers", "headers already sent", "output started at", "call to a missing function", "call to undefined function", "undefined variable", "undefined index", "undefined offset", "undefined property", "failed to open stream", "no such file or directory", "null pointer", "division by zero", "unexpected token", "unexpected end of", "allowed memory size", "maximum execution time", "lost connection to", "null reference", "object reference not set", "cannot read property", "cannot read properties", "is not a function", "is not defined",
)
# Filler and tasks, put together from their words.
_STUBS = [f"{a} {b}" for a in ("sample", "placeholder", "example", "dummy", "filler", "final") for b in ("text", "copy", "wording", "content", "heading", "code", "example", "data", "paragraph", "sentence", "answer", "question", "title", "summary", "value", "image")]
_STUBS += [f"{a} {b}" for a in ("text", "wording", "content", "details", "description", "heading", "title", "summary") for b in ("to follow", "to come", "folgt", "suivra", "goes here", "go here", "comes here", "kommt hier", "va ici")]
#: Words for what stands in for content, and what such a sentence says of it.
STAND_INS = ("placeholder", "sample", "example", "dummy", "filler", "your", "beispiel", "platzhalter", "exemple", "ejemplo")
HERE = ("goes here", "go here", "comes here", "kommt hier", "hier steht", "va ici", "va aqui", "vai aqui")
_TASKS = [
    f"{a}{sign}{verb}"
    for a in ("todo", "to do", "fixme", "tbd", "xxx")
    for sign in (": ", " - ", ":")
    for verb in ("add", "insert", "write", "supply", "fill", "put", "describe", "complete", "provide", "finish", "explain", "replace", "update")
]
#: Words for scripts, and stems of what has to be done with them.
SCRIPT_WORDS = ("javascript", "java script", "js", "cookie", "cookies", "scripts", "scripting", "skripte", "skripten", "skript")
DEEDS = (
    "enable", "enabled", "required", "require", "requires", "needs", "need", "turn on", "turned on", "turned off", "turn it on", "switch on", "switch it on", "switched on", "switched off", "activate", "activated", "allow", "allowed", "allowing", "blocked", "disabled", "without", "aktivier", "erlauben", "benotig", "deaktiviert", "activer", "activez", "autoriser", "desactive", "necessaire", "active", "activar", "habilit", "permita", "permite", "desactivado", "ative", "ativar", "attiva", "abilita", "schakel", "inschakelen", "zet", "wlacz", "aktivera", "aktiver", "включите", "включить", "разрешите",
)
#: Words of a sentence that tells or explains something.
TELLING = ("fixed", "solved", "worked", "works", "helped", "for me", "my", "because", "otherwise", "else", "i", "i'd", "i've", "so that you", "means", "if you", "why", "which", "when i", "you should", "you must")

_FENCES = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", re.S | re.I)
_INLINE = re.compile(r"`[^`\n]+`")
_INDENTED = re.compile(r"(?m)^(?: {4}|\t).*$")
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|「[^」\n]+」|<noscript>(?:(?!<noscript>).)*?</noscript>|<blockquote\b.*?</blockquote>", re.S | re.I)
_CITED = re.compile(r"(?m)^\s*>.*$")
_QUOTE_SIGNS = re.compile(r"[\"“„«「<]")
_SLOT_SIGNS = re.compile(r"[\[{<«%@_$]")

_NAME = r"[ ]?[^\W\d][\w .]{0,40}[ ]?"
_VERB = r"\s?(?:add|enter|insert|your|write|fill in|put|type|name of|your own|ihr|ihre|dein|votre|su|tu|hier|saisir|insertar|einfügen)\b[ _][\w .]{1,40}\s?"
_SLOTS = re.compile(
    rf"\{{\{{{_NAME}\}}\}}|\$\{{{_NAME}\}}|#\{{{_NAME}\}}|<%=?{_NAME}%>|\{{%{_NAME}%\}}|%%{_NAME}%%|%\({_NAME}\)[sdf]|@@{_NAME}@@|(?<!\w)__{_NAME}__(?!\w)|\[\[{_NAME}\]\]"
    rf"|\[{_VERB}\]|\{{{_VERB}\}}|<{_VERB}>|«{_VERB}»|\[(?:add|enter|insert|your)_\w+\]",
    re.I,
)
#: A sentence with these is about placeholders or missing values.
_ABOUT = re.compile(
    r"where it says|instead of|print(?:s|ed)?\b|placeholder|literal|syntax|the string|variable|means\b|called|escape|render|shows? up as|ends? up|replaced? (?:by|with)|platzhalter|statt\b|au lieu|en lugar|вместо", re.I
)
_GREETING = r"(?:hello|hi|hey|dear|welcome back,?|hallo|liebe[r]?|bonjour|cher|chère|hola|estimad[oa]|olá|ciao|здравствуйте,?|привет,?|posted by|by|from|on|your (?:question|post)|votes? on)"
_MISSING_VALUE = r"(?:null|undefined|nan|none|nil|\(null\)|\[object object\]|invalid date)"
_LOST = re.compile(rf"(?<![\w.`'\"=]){_MISSING_VALUE}(?![\w`'\"=(]|\.\w)", re.I)
_LOST_GREETING = re.compile(rf"\b{_GREETING}\s+{_MISSING_VALUE}(?!\w)", re.I)
#: A printed missing value is spelt as programs spell it.
_SPELT = re.compile(r"null|undefined|NaN|None|nil|\(null\)|\[object Object\]|Invalid Date")
_SENTENCES = re.compile(r"[^.!?。！？…\n|]+(?:[.!?。！？…|]+(?=\s|$|[^\x00-\x7f])|[.!?](?=\S)[^.!?。！？…\n|]*)*[.!?。！？…|]*|\n")


def plain(text: str) -> str:
    """Lower case, without marks on letters and invisible characters, with ordinary apostrophes."""
    text = text.lower().replace("’", "'")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        gone = [c for c in set(text) if ord(c) > 127 and unicodedata.category(c) in ("Mn", "Me", "Cf")]
        text = text.translate(dict.fromkeys(map(ord, gone)))
    return text


_PAGE, _SCRIPT, _DEED, _TELL, _STAND_IN, _HERE = range(6)
#: Kinds that count with all that stands between them.
_PAIRS = ((_SCRIPT, _DEED), (_STAND_IN, _HERE))
#: Words without digits; the letters of a sentence are counted in these.
_LETTERS = re.compile(r"[^\W\d_]+(?![\w])", re.U)


def _letters(text: str) -> int:
    return sum(map(len, _LETTERS.findall(text)))


class Finder:
    """The automaton over all phrases."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, int] = {}
        status = [str(code) for code in (*range(400, 432), 451, *range(500, 512), *range(520, 531))]
        for kind, phrases in (
            (_PAGE, (*ERRORS, *SCRIPTS, *FURNITURE, *FILLER, *PAGES, *DUMPS, *_STUBS, *_TASKS, *status)),
            (_TELL, TELLING), (_DEED, DEEDS), (_SCRIPT, SCRIPT_WORDS), (_STAND_IN, STAND_INS), (_HERE, HERE),
        ):
            kinds |= {plain(p): kind for p in phrases}
        for phrase, kind in kinds.items():
            self.automaton.add_word(phrase, (len(phrase), kind))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the phrases in a plain text, at word boundaries; stems may go on."""
        spans = []
        for end, (length, kind) in self.automaton.iter(text):
            start = end - length + 1
            if start and text[start].isalnum() and text[start].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._"):
                continue
            if kind != _DEED and end + 1 < len(text) and text[end].isalnum() and text[end + 1].isalnum() and text[end].isascii():
                continue
            spans.append((start, end + 1, kind))
        return spans

    def covers(self, sentence: str) -> bool:
        """Whether a plain sentence is page text or filler rather than content."""
        spans = self.found(sentence)
        return bool(spans) and self.covered(sentence, spans)

    @staticmethod
    def covered(sentence: str, spans: list[tuple[int, int, int]]) -> bool:
        marked = [(a, b) for a, b, kind in spans if kind in (_PAGE, _HERE)]
        for one, other in _PAIRS:
            first = [(a, b) for a, b, kind in spans if kind == one]
            for c, d, kind in spans if first else ():
                if kind == other:
                    marked += [(min(a, c), max(b, d)) for a, b in first if max(a, c) - min(b, d) <= REACH]
        if not marked:
            return False
        matched = reach = 0
        for start, end in sorted(marked):
            if end > reach:
                matched += _letters_in(sentence, max(start, reach), end)
                reach = end
        need = TOLD if any(kind == _TELL and not any(a <= x and y <= b for a, b in marked) for x, y, kind in spans) else SENTENCE
        total = _letters(sentence)
        return matched >= need * total if total else matched > 0 or any(c.isdigit() for c in sentence)


def _letters_in(sentence: str, start: int, end: int) -> int:
    return sum(c.isalpha() for c in sentence[start:end])


def mumbled(words: list[str]) -> bool:
    """Pseudo-Latin, a few words over and over, or runs over the keys."""
    n = len(words)
    if n < 3:
        return False
    if n >= 5:
        few = set(words[:12])
        if len(few) <= 3:
            few = set(words)
            if len(few) <= 3 and max(map(words.count, few)) >= 0.7 * n:
                return True
        if n >= 6 and _mostly(words, 0.75, _latin):
            return True
    return _mostly(words, 0.8, _RUNS.__contains__)


def _latin(word: str) -> bool:
    return word in _LATIN_SET or bool(_SYLLABLES.match(word))


def _mostly(words: list[str], share: float, test) -> bool:
    """Whether ``test`` holds for ``share`` of the words; gives up at the first word too many."""
    spare = len(words) - share * len(words)
    for w in words:
        if not test(w):
            spare -= 1
            if spare < 0:
                return False
    return True


_LATIN_SET = frozenset(LATIN)
_WORD = re.compile(r"[^\W\d_]+")
_COVERED_MARK = "\x00"


def judged(finder: Finder, text: str | None) -> str | None:
    """Why ``text`` is residue: ``placeholder``, ``missing``, ``page``, ``filler``; None if it is not.

    The first of several lines is a title if it is one sentence.
    """
    if not text or not text.strip():
        return None
    own = _CITED.sub("\n", text) if ">" in text else text
    if "```" in own or "~~~" in own or "<" in own:
        own = _FENCES.sub(_blank, own)
    if "    " in own or "\t" in own:
        own = _INDENTED.sub(_blank, own)
    if "`" in own:
        own = _INLINE.sub(_blank, own)
    # Slots in the author's own prose; guillemets may be a slot's, so look before quotations go.
    for match in _SLOTS.finditer(own) if _SLOT_SIGNS.search(own) else ():
        if not _inside(match, own) and not _ABOUT.search(_sentence_at(own, match.start())):
            return "placeholder"
    prose = _QUOTED.sub(_blank, own) if _QUOTE_SIGNS.search(own) else own
    if "\x01" in prose and not prose.replace("\x01", "").strip() or "<noscript>" in text:
        inner = re.fullmatch(r"\s*<noscript>(.*)</noscript>\s*", own, re.S | re.I)
        prose = inner[1] if inner else prose
    if _SPELT.search(prose):
        for line in prose.split("\n"):
            values = [m[0] for m in _LOST.finditer(line) if _SPELT.fullmatch(m[0])]
            if (len(values) >= 2 or (values and _LOST_GREETING.search(line))) and not _ABOUT.search(line):
                return "missing"
    lines = (html.unescape(prose) if "&" in prose else prose).split("\n")
    full = [x for x in lines if x.strip()]
    if _covered(finder, full):
        return "page"
    hidden = prose.count("\x01")
    if hidden < 0.3 * len(prose):
        words = [_WORD.findall(x.lower()) for x in full]
        if mumbled([w for line in words for w in line]) or mumbled([w for line in words[1:] for w in line]):
            return "filler"
    return None


def _blank(match: re.Match) -> str:
    return "\x01" * len(match[0])


def _inside(match: re.Match, text: str) -> bool:
    """Whether a match stands inside a quotation of its line."""
    for quoted in _QUOTED.finditer(text, text.rfind("\n", 0, match.start()) + 1):
        if quoted.start() > match.start():
            return False
        if quoted.start() < match.start() and quoted.end() > match.end():
            return True
    return False


def _sentence_at(text: str, at: int) -> str:
    start = max(text.rfind(c, 0, at) for c in ("\n", ". ", "! ", "? ")) + 1
    ends = [e for e in (text.find(c, at) for c in ("\n", ". ", "! ", "? ")) if e >= 0]
    return text[start : min(ends, default=len(text))]


def _covered(finder: Finder, lines: list[str]) -> bool:
    """Whether most of the letters are covered or, under a title, most of those after it.

    Stops as soon as what is left to judge cannot change the answer.
    """
    parts = [[m[0] for m in _SENTENCES.finditer(line)] for line in lines]
    sizes = [_letters(line) + line.count("\x01") for line in lines]
    total = sum(sizes)
    under = total - sizes[0] if len(parts) > 1 and len(parts[0]) == 1 else 0
    if not total:  # a status code and no word
        return any("\x01" not in x and finder.covers(plain(x)) for line in parts for x in line)
    covered = below = 0
    left, left_below = total, under
    for number, line in enumerate(parts):
        for sentence in line:
            words = _LETTERS.findall(sentence)
            size = sum(map(len, words)) + sentence.count("\x01")
            counts = "\x01" not in sentence and (finder.covers(plain(sentence)) or mumbled([w.lower() for w in words]))
            left -= size
            covered += size * counts
            if number:
                left_below -= size
                below += size * counts
            if covered + left < COVERED * total and (not under or below + left_below < COVERED * under):
                return False
    return covered >= COVERED * total or (under > 0 and below >= COVERED * under)


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, reason): the documents whose text is residue.

    Null, empty and blank texts are none. Long texts are read whole. Repeated
    rows give one row per distinct id and reason; rows without ``doc_id`` are left out; other columns are
    ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = [
                (i, why)
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                if (why := judged(finder, t))
            ]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    rows = spread(documents.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id bigint, reason string").distinct()


def clean(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` without the ones found."""
    return documents.join(found.select("doc_id"), "doc_id", "left_anti")
