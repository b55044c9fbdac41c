"""Stemmers after the published Snowball descriptions; languages without one keep their words.

Each is a sequence of suffix lists over the published regions R1, R2 and RV.
"""

from __future__ import annotations

import re
from functools import lru_cache


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Start of R1 and R2."""
    def after(at: int) -> int:
        for i in range(at + 1, len(word)):
            if word[i] not in vowels and word[i - 1] in vowels:
                return i + 1
        return len(word)

    r1 = after(0)
    return r1, after(r1) if r1 < len(word) else len(word)


def _romance_rv(word: str, vowels: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


def _ending(word: str, endings, start: int = 0) -> str:
    """The longest of the endings that the word has from ``start`` on."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


# --- English ------------------------------------------------------------------------

_EN_V = "aeiouy"
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_EN_STOP = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _en_short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    word = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", word))
    r1, r2 = _regions(word, _EN_V)
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            r2 = next((i + 1 for i in range(r1 + 1, len(word)) if word[i] not in _EN_V and word[i - 1] in _EN_V), len(word))
    word = re.sub(r"'(?:s'?)?$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _EN_V for c in word[:-2]):
        word = word[:-1]
    if word in _EN_STOP:
        return word
    e = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(word) - len(e) >= r1:
            word = word[: -len(e)] + "ee"
    elif e and any(c in _EN_V for c in word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif _en_short(word, r1):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _EN_V:
        word = word[:-1] + "i"
    e = _ending(word, (*_EN_2, "ogi", "li"))
    if e and len(word) - len(e) >= r1:
        if e == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif e == "li":
            word = word[:-2] if word[-3:-2] and word[-3] in "cdeghkmnrt" else word
        else:
            word = word[: -len(e)] + _EN_2[e]
    e = _ending(word, (*_EN_3, "ative"))
    if e and len(word) - len(e) >= r1:
        if e == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(e)] + _EN_3[e]
    e = _ending(word, (*_EN_4, "ion"))
    if e and len(word) - len(e) >= r2 and (e != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(e)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _en_short(word[:-1], len(word) - 1)):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# --- German -------------------------------------------------------------------------

_DE_V = "aeiouyäöü"


def german(word: str) -> str:
    word = word.replace("ß", "ss")
    word = re.sub(rf"(?<=[{_DE_V}])u(?=[{_DE_V}])", "U", word)
    word = re.sub(rf"(?<=[{_DE_V}])y(?=[{_DE_V}])", "Y", word)
    r1, r2 = _regions(word, _DE_V)
    r1 = max(r1, min(3, len(word)))
    e = _ending(word, ("em", "ern", "er", "e", "en", "es", "s"))
    if e and len(word) - len(e) >= r1:
        if e == "s":
            word = word[:-1] if word[-2:-1] and word[-2] in "bdfghklmnrt" else word
        else:
            word = word[: -len(e)]
            if e in ("e", "en", "es") and word.endswith("niss"):
                word = word[:-1]
    e = _ending(word, ("en", "er", "est", "st"))
    if e and len(word) - len(e) >= r1:
        if e != "st":
            word = word[: -len(e)]
        elif len(word) >= 6 and word[-3] in "bdfghklmnt":
            word = word[:-2]
    e = _ending(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if e and len(word) - len(e) >= r2:
        stem_ = word[: -len(e)]
        if e in ("end", "ung"):
            word = stem_
            if word.endswith("ig") and len(word) - 2 >= r2 and word[-3:-2] != "e":
                word = word[:-2]
        elif e in ("ig", "ik", "isch"):
            word = stem_ if stem_[-1:] != "e" else word
        elif e in ("lich", "heit"):
            word = stem_
            if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                word = word[:-2]
        else:
            word = stem_
            tail = _ending(word, ("lich", "ig"))
            if tail and len(word) - len(tail) >= r2:
                word = word[: -len(tail)]
    return word.translate(str.maketrans("UYäöü", "uyaou"))


# --- Spanish ------------------------------------------------------------------------

_ES_V = "aeiouáéíóúü"
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_VERB_A = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_VERB_B = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()


def spanish(word: str) -> str:
    rv = _romance_rv(word, _ES_V)
    r1, r2 = _regions(word, _ES_V)
    e = _ending(word, _ES_PRONOUNS, rv)
    if e:
        base = word[: -len(e)]
        verb = _ending(base, ("iéndo", "ándo", "ár", "ér", "ír"), rv)
        if verb:
            word = base[: -len(verb)] + verb.translate(_ES_PLAIN)
        elif _ending(base, ("ando", "iendo", "ar", "er", "ir"), rv) or (base.endswith("uyendo") and len(base) - 5 >= rv):
            word = base
    before = word
    standard = ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias"
                " logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos").split()
    e = _ending(word, standard)
    if e:
        at = len(word) - len(e)
        if e in ("logía", "logías"):
            word = word[:at] + "log" if at >= r2 else word
        elif e in ("ución", "uciones"):
            word = word[:at] + "u" if at >= r2 else word
        elif e in ("encia", "encias"):
            word = word[:at] + "ente" if at >= r2 else word
        elif e == "amente":
            if at >= r1:
                word = word[:at]
                if word.endswith("iv") and len(word) - 2 >= r2:
                    word = word[:-2]
                    if word.endswith("at") and len(word) - 2 >= r2:
                        word = word[:-2]
                elif word.endswith(("os", "ic", "ad")) and len(word) - 2 >= r2:
                    word = word[:-2]
        elif at >= r2:
            word = word[:at]
            more = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"), "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",)}.get(e, ("ic",) if e in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias") else ())
            tail = _ending(word, more, r2)
            if tail:
                word = word[: -len(tail)]
    if word == before:
        e = _ending(word, _ES_VERB_A, rv)
        if e and word[: -len(e)].endswith("u"):
            word = word[: -len(e)]
        else:
            e = _ending(word, ("en", "es", "éis", "emos", *_ES_VERB_B), rv)
            if e:
                word = word[: -len(e)]
                if e in ("en", "es", "éis", "emos") and word.endswith("gu"):
                    word = word[:-1]
    e = _ending(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if e:
        word = word[: -len(e)]
        if e in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ES_PLAIN)


# --- Portuguese ---------------------------------------------------------------------

_PT_V = "aeiouáéíóúâêô"
_PT_VERB = "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras".split()


def portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    rv = _romance_rv(word, _PT_V)
    r1, r2 = _regions(word, _PT_V)
    before = word
    standard = ("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância logia logias ução uça~o uço~es ência ências"
                " amente mente idade idades iva ivo ivas ivos ira iras").split()
    e = _ending(word, standard)
    if e:
        at = len(word) - len(e)
        if e in ("logia", "logias"):
            word = word[:at] + "log" if at >= r2 else word
        elif e in ("uça~o", "uço~es"):
            word = word[:at] + "u" if at >= r2 else word
        elif e in ("ência", "ências"):
            word = word[:at] + "ente" if at >= r2 else word
        elif e == "amente":
            if at >= r1:
                word = word[:at]
                tail = _ending(word, ("iv", "os", "ic", "ad"), r2)
                if tail:
                    word = word[:-2]
                    if tail == "iv" and word.endswith("at") and len(word) - 2 >= r2:
                        word = word[:-2]
        elif e in ("ira", "iras"):
            if at >= rv and word[:at].endswith("e"):
                word = word[:at] + "ir"
        elif at >= r2:
            word = word[:at]
            more = {"mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(e, ("at",) if e in ("iva", "ivo", "ivas", "ivos") else ())
            tail = _ending(word, more, r2)
            if tail:
                word = word[: -len(tail)]
    changed = word != before
    if not changed:
        e = _ending(word, _PT_VERB, rv)
        if e:
            word, changed = word[: -len(e)], True
    if changed:
        if word.endswith("i") and len(word) - 1 >= rv and word[-2:-1] == "c":
            word = word[:-1]
    else:
        e = _ending(word, ("os", "a", "i", "o", "á", "í", "ó"), rv)
        if e:
            word = word[: -len(e)]
    if word.endswith(("e", "é", "ê")) and len(word) - 1 >= rv:
        word = word[:-1]
        if (word.endswith("gu") or word.endswith("ci")) and len(word) - 1 >= rv:
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


# --- French -------------------------------------------------------------------------

_FR_V = "aeiouyâàëéêèïîôûù"
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_FR_1 = (
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements"
    " ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
).split()


def french(word: str) -> str:
    word = re.sub(r"(?<=q)u", "U", word)
    word = re.sub(rf"(?<=[{_FR_V}])([ui])(?=[{_FR_V}])", lambda m: m[1].upper(), word)
    word = re.sub(rf"y(?=[{_FR_V}])|(?<=[{_FR_V}])y", "Y", word)
    if len(word) >= 2 and word[0] in _FR_V and word[1] in _FR_V or word.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(word)) if word[i] in _FR_V), len(word))
    r1, r2 = _regions(word, _FR_V)
    before, open_verbs = word, False
    e = _ending(word, _FR_1)
    at = len(word) - len(e)

    def drop(w: str, tails: tuple[str, ...], region: int) -> tuple[str, str]:
        tail = _ending(w, tails)
        return (w[: -len(tail)], tail) if tail and len(w) - len(tail) >= region else (w, "")

    if e in ("amment", "emment"):
        open_verbs = at >= rv
        word = word[:at] + e[0] + "nt" if at >= rv else word
    elif e in ("ment", "ments"):
        if at - 1 >= rv and word[at - 1] in _FR_V:
            word, open_verbs = word[:at], True
    elif e in ("ement", "ements"):
        if at >= rv:
            word = word[:at]
            if word.endswith("iv"):
                word, gone = drop(word, ("iv",), r2)
                if gone:
                    word = drop(word, ("at",), r2)[0]
            elif word.endswith("eus"):
                if len(word) - 3 >= r2:
                    word = word[:-3]
                elif len(word) - 3 >= r1:
                    word = word[:-1] + "x"
            elif word.endswith(("abl", "iqU")):
                word = drop(word, ("abl", "iqU"), r2)[0]
            elif word.endswith(("ièr", "Ièr")) and len(word) - 3 >= rv:
                word = word[:-3] + "i"
    elif e in ("eaux", "aux"):
        word = word[:-1] if e == "eaux" else word[:at] + "al" if at >= r1 else word
    elif e in ("euse", "euses"):
        word = word[:at] if at >= r2 else word[:at] + "eux" if at >= r1 else word
    elif e in ("issement", "issements"):
        word = word[:at] if at >= r1 and at and word[at - 1] not in _FR_V else word
    elif e and at >= r2:
        if e in ("logie", "logies"):
            word = word[:at] + "log"
        elif e in ("usion", "ution", "usions", "utions"):
            word = word[:at] + "u"
        elif e in ("ence", "ences"):
            word = word[:at] + "ent"
        else:
            word = word[:at]
            if e.startswith("at"):
                if word.endswith("ic"):
                    word = word[:-2] if len(word) - 2 >= r2 else word[:-2] + "iqU"
            elif e in ("ité", "ités"):
                if word.endswith("abil"):
                    word = word[:-4] if len(word) - 4 >= r2 else word[:-2] + "l"
                elif word.endswith("ic"):
                    word = word[:-2] if len(word) - 2 >= r2 else word[:-2] + "iqU"
                else:
                    word = drop(word, ("iv",), r2)[0]
            elif e in ("if", "ive", "ifs", "ives"):
                word, gone = drop(word, ("at",), r2)
                if gone and word.endswith("ic"):
                    word = word[:-2] if len(word) - 2 >= r2 else word[:-2] + "iqU"
    changed = word != before
    if not changed or open_verbs:
        verbs = word
        e = _ending(word, _FR_I, rv)
        at = len(word) - len(e)
        if e and at - 1 >= rv and word[at - 1] not in _FR_V:
            word = word[:at]
        if word == verbs:
            e = _ending(word, ("ions", *_FR_E, *_FR_A), rv)
            at = len(word) - len(e)
            if e == "ions":
                word = word[:at] if at >= r2 else word
            elif e in _FR_E:
                word = word[:at]
            elif e:
                word = word[:at]
                if word.endswith("e") and len(word) - 1 >= rv:
                    word = word[:-1]
        changed = changed or word != verbs
    if changed:
        word = word[:-1] + "i" if word.endswith("Y") else word[:-1] + "c" if word.endswith("ç") else word
    else:
        if word.endswith("s") and len(word) > 1 and word[-2] not in "aiouès":
            word = word[:-1]
        e = _ending(word, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
        at = len(word) - len(e)
        if e == "ion":
            word = word[:at] if at >= r2 and at - 1 >= rv and word[at - 1] in "st" else word
        elif e == "e":
            word = word[:-1]
        elif e:
            word = word[:at] + "i"
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    word = re.sub(rf"[éè](?=[^{_FR_V}]+$)", "e", word)
    return word.replace("I", "i").replace("U", "u").replace("Y", "y")


# --- Italian ------------------------------------------------------------------------

_IT_V = "aeiouàèìòù"
_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_IT_1 = (
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti azione azioni atore atori"
    " logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive"
).split()
_IT_2 = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete"
    " eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(word: str) -> str:
    word = word.translate(str.maketrans("áéíóú", "àèìòù"))
    word = re.sub(r"(?<=q)u", "U", word)
    word = re.sub(rf"(?<=[{_IT_V}])([ui])(?=[{_IT_V}])", lambda m: m[1].upper(), word)
    rv = _romance_rv(word, _IT_V)
    r1, r2 = _regions(word, _IT_V)
    e = _ending(word, _IT_PRONOUNS, rv)
    if e:
        base = word[: -len(e)]
        if _ending(base, ("ando", "endo"), rv):
            word = base
        elif _ending(base, ("ar", "er", "ir"), rv):
            word = base + "e"
    before = word
    e = _ending(word, _IT_1)
    at = len(word) - len(e)
    if e in ("amento", "amenti", "imento", "imenti"):
        word = word[:at] if at >= rv else word
    elif e == "amente":
        if at >= r1:
            word = word[:at]
            tail = _ending(word, ("iv", "os", "ic", "abil"), r2)
            if tail:
                word = word[: -len(tail)]
                if tail == "iv" and word.endswith("at") and len(word) - 2 >= r2:
                    word = word[:-2]
    elif e and at >= r2:
        if e in ("logia", "logie"):
            word = word[:at] + "log"
        elif e in ("uzione", "uzioni", "usione", "usioni"):
            word = word[:at] + "u"
        elif e in ("enza", "enze"):
            word = word[:at] + "ente"
        else:
            word = word[:at]
            if e in ("azione", "azioni", "atore", "atori"):
                tail = _ending(word, ("ic",), r2)
            elif e == "ità":
                tail = _ending(word, ("abil", "ic", "iv"), r2)
            elif e in ("ivo", "ivi", "iva", "ive"):
                tail = _ending(word, ("at",), r2)
            else:
                tail = ""
            if tail:
                word = word[: -len(tail)]
                if tail == "at" and word.endswith("ic") and len(word) - 2 >= r2:
                    word = word[:-2]
    if word == before:
        e = _ending(word, _IT_2, rv)
        if e:
            word = word[: -len(e)]
    if word and word[-1] in "aeioàèìò" and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith("i") and len(word) - 1 >= rv:
            word = word[:-1]
    if word.endswith(("ch", "gh")) and len(word) - 2 >= rv:
        word = word[:-1]
    return word.replace("I", "i").replace("U", "u")


# --- Danish, Norwegian, Swedish: one region, short suffix lists ---------------------


def _nordic(word: str, vowels: str, first: list[str], s_after: str, clusters: tuple[str, ...], last: list[str], undo: dict[str, str]) -> str:
    r1, _ = _regions(word, vowels)
    r1 = max(r1, min(3, len(word)))
    e = _ending(word, (*first, "s"))
    if e and len(word) - len(e) >= r1:
        if e == "s":
            word = word[:-1] if word[-2:-1] and word[-2] in s_after else word
        else:
            word = word[: -len(e)]
    if word.endswith(clusters) and len(word) - 2 >= r1:
        word = word[:-1]
    e = _ending(word, (*last, *undo))
    if e and len(word) - len(e) >= r1:
        word = word[: -len(e)] + undo.get(e, "")
    return word


def swedish(word: str) -> str:
    first = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()
    return _nordic(word, "aeiouyäåö", first, "bcdfghjklmnoprtvy", ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), "lig ig els".split(), {"löst": "lös", "fullt": "full"})


def danish(word: str) -> str:
    first = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()
    if word.endswith("igst"):
        word = word[:-2]
    word = _nordic(word, "aeiouyæåø", first, "abcdfghjklmnoprtvyzå", ("gd", "dt", "gt", "kt"), "ig lig elig els".split(), {"løst": "løs"})
    r1 = max(_regions(word, "aeiouyæåø")[0], min(3, len(word)))
    if len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiouyæåø" and len(word) - 1 >= r1:
        word = word[:-1]
    return word


def norwegian(word: str) -> str:
    first = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
    return _nordic(word, "aeiouyæåø", first, "bcdfghjlmnoprtvyz", ("dt", "vt"), "leg eleg ig eig lig elig els lov elov slov hetslov".split(), {"erte": "er", "ert": "er"})


# --- Dutch --------------------------------------------------------------------------

_NL_V = "aeiouyè"


def dutch(word: str) -> str:
    word = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    word = re.sub(rf"^y|(?<=[{_NL_V}])y", "Y", word)
    word = re.sub(rf"(?<=[{_NL_V}])i(?=[{_NL_V}])", "I", word)
    r1, r2 = _regions(word, _NL_V)
    r1 = max(r1, min(3, len(word)))
    single = lambda w: w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    def without_en(w: str, e: str) -> str:
        base = w[: -len(e)]
        return single(base) if len(base) >= r1 and base and base[-1] not in _NL_V and not base.endswith("gem") else w

    def without_e(w: str) -> tuple[str, bool]:
        if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] and w[-2] not in _NL_V:
            return single(w[:-1]), True
        return w, False

    e = _ending(word, ("heden", "en", "ene", "s", "se"))
    if e == "heden":
        word = word[:-5] + "heid" if len(word) - 5 >= r1 else word
    elif e in ("en", "ene"):
        word = without_en(word, e)
    elif e and len(word) - len(e) >= r1 and word[: -len(e)][-1:] and word[: -len(e)][-1] not in _NL_V + "j":
        word = word[: -len(e)]
    word, cut = without_e(word)
    if word.endswith("heid") and len(word) - 4 >= r2 and word[-5:-4] != "c":
        word = word[:-4]
        if word.endswith("en"):
            word = without_en(word, "en")
    e = _ending(word, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if e and len(word) - len(e) >= r2:
        base = word[: -len(e)]
        if e in ("end", "ing"):
            word = base[:-2] if base.endswith("ig") and len(base) - 2 >= r2 and base[-3:-2] != "e" else single(base)
        elif e == "ig":
            word = base if base[-1:] != "e" else word
        elif e == "lijk":
            word = without_e(base)[0]
        elif e == "baar" or cut:
            word = base
    if len(word) >= 4 and word[-1] not in _NL_V + "I" and word[-2] == word[-3] and word[-2] in "aeou" and word[-4] not in _NL_V:
        word = word[:-2] + word[-1]
    return word.replace("I", "i").replace("Y", "y")


# --- Russian ------------------------------------------------------------------------

_RU_V = "аеиоуыэюя"
_RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in _RU_V), len(word))
    _, r2 = _regions(word, _RU_V)

    def cut(w: str, after_a: list[str], free: list[str]) -> str | None:
        """Without the longest ending; those of the first list stand only behind а or я."""
        fits = [e for e in free if w.endswith(e) and len(w) - len(e) >= rv]
        fits += [e for e in after_a if w.endswith(e) and len(w) - len(e) - 1 >= rv and w[-len(e) - 1] in "ая"]
        return w[: -len(max(fits, key=len))] if fits else None

    done = cut(word, *_RU_GERUND)
    if done is None:
        word = cut(word, [], ["ся", "сь"]) or word
        done = cut(word, [], _RU_ADJECTIVE)
        if done is not None:
            done = cut(done, *_RU_PARTICIPLE) or done
        else:
            done = cut(word, *_RU_VERB)
            if done is None:
                done = cut(word, [], _RU_NOUN)
    word = done if done is not None else word
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    e = _ending(word, ("ост", "ость"), r2)
    if e:
        word = word[: -len(e)]
    e = _ending(word, ("ейш", "ейше"), rv)
    if e:
        word = word[: -len(e)]
    if word.endswith("нн"):
        word = word[:-1]
    elif not e and word.endswith("ь") and len(word) - 1 >= rv:
        word = word[:-1]
    return word


STEMMERS = {"nl": dutch, "ru": russian, "fr": french, "it": italian, "sv": swedish, "da": danish, "no": norwegian, "nb": norwegian, "en": english, "de": german, "es": spanish, "pt": portuguese}


@lru_cache(maxsize=200_000)
def stem(word: str, lang: str | None = "fr") -> str:
    """The stem of a word in a language given as ``xx`` or ``xx-YY``; null and other languages give the word in lower case."""
    low = word.lower()
    stemmer = STEMMERS.get((lang or "").lower().split("-")[0])
    return stemmer(low) if stemmer and low else low
