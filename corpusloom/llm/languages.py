"""Problem 2: missing or wrong language labels and mixed-language documents.

Prediction by partial matching. Each language has byte context trees of orders 0 to
``ORDER``; a context that has not seen the next byte escapes to the next shorter one
(escape method C). The statistics are frozen after training, so the code length of
a byte is a fixed function of the ``ORDER + 1`` bytes that end in it. It is worked out
once for every gram of the training text, in all languages together; scoring is one table look-up
a byte, and the escapes of unseen grams are added on the way to shorter ones. A page's
language is the one with the shortest code; a Viterbi path over its words, with a price
for each change of language, yields the mixed-language segments.

Training text: at most about ``SAMPLE`` labelled rows of each language, chosen by a
hash of the id over the whole table, cleaned of rows whose seed-text model disagrees with the
label. This bounds the model, which is sent to the executors, to some megabytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest context, in bytes.
ORDER = 4
#: Labelled rows of each language for training, about.
SAMPLE = 250
#: Code points of training text of a language at most, in whole texts; a longer text alone is taken whole.
SAMPLE_CHARS = 2_000_000
#: Bits that a change of language inside a line costs.
CHANGE = 14.0
#: Words in a row that make a passage.
PASSAGE = 15
#: Words whose mean evidence makes the confidence.
EVIDENCE = 3
#: Confidence of a segment that goes on a stretch over a line's end.
PLAIN = 0.9
#: Bits a word in the best language, bits a word to the second and words from which on a text is in none of the languages.
OTHER_BITS, OTHER_MARGIN, OTHER_WORDS = 40.0, 4.0, 10
#: Words that a line needs to speak for the page.
LINE_WORDS = 8

LANGUAGES = ("en", "fr", "de", "es", "it", "pt")

# Seed texts: common words and phrases of each language, to start the training.
SEEDS = {
    "en": "the of and to in a is that it was for on are as with his they at be this have from or had by but what some we can out other were all there when up use your how said an each she which their time if will way about many then them would like so these her long make thing see him two has look more day could go come did my no most who over know than call first people may down been now find any new work part take get place made where after back little only round man year came show every good me give our under very through just great think say help low line before turn cause much mean differ move right boy old too does tell sentence set three want air well also play small end put home read hand port large spell add even land here must big high such follow act why ask men change went light kind off need house picture try us again animal point mother world near build self earth father whatever although though nobody everyone because until while since without during between against according following",
    "fr": "le la les de des du un une et est dans que qui pour pas sur plus par ce il elle avec sont ne se au aux nous vous mais ou leur leurs tout cette ces son sa ses été avoir être fait comme aussi bien deux même sans encore entre après avant quand peu où alors donc depuis dont peut faire très autre autres premier toujours jamais rien chaque pendant contre selon parce lorsque ainsi déjà ici année années jour temps vie monde homme femme enfant ville pays eau travail groupe question moins trop beaucoup quelque quelques notre votre je tu on lui y en si cela ceci ont avait avaient étaient sera seront était une partie des habitants près de à la suite du premier rapport il n'y a pas de quoi c'est ce qu'on dit afin que bien que même si tandis que aucun personne presque autant jusqu'à",
    "de": "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte gibt alle seit muss wurden beim doch jetzt waren drei jahre neue neuen damit bereits da ihr seinen müssen ab ihrer ohne sondern selbst ersten nun etwa heute weil ihm menschen dort ihren dazu obwohl während niemand jeder kaum jemand meisten laut zeit haus stadt wasser leben arbeit schule gruppe bericht frage ob zwar jedoch deren dessen wegen obgleich damit jedes dorf nahe aus",
    "es": "el la los las de del un una y es en que por con no para su sus al lo como más pero se le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas fue era son está han había ser tiene según después año años día tiempo vida mundo hombre mujer casa ciudad agua trabajo grupo pregunta parte vez dos tres bien aunque mientras nadie cada casi ahora todavía aún cerca de junto a lo que dijo el pueblo se ha hecho los vecinos que viven en cuanto ningún siempre nunca primero gran mejor",
    "it": "il lo la i gli le di del della dei delle degli un uno una e è in che per con non su si al alla ai come più ma da dal dalla dai ha sono anche se o questo questa questi quando molto senza sul sulla tra fra dopo prima dove chi quale quali nel nella nei nelle loro suo sua suoi sue mio tuo noi voi essi egli lei lui ci vi ne già ancora sempre mai tutto tutti tutta tutte ogni altro altri altra altre due tre stato stata stati era erano essere avere fatto così perché mentre quasi contro secondo durante presso vicino anno anni giorno tempo vita mondo uomo donna casa città acqua lavoro gruppo domanda parte volta volte bene benché sebbene affinché finché nessuno qualcuno qualunque poco pochi cosa ciò quello quella quelli hanno aveva avevano sarà può possono deve molti persone paese primo ultimo nuovo grande",
    "pt": "o a os as de do da dos das um uma e é em que para por com não no na nos nas se ao aos mais como mas foi ele ela eles elas seu sua seus suas ou quando muito já está eu também só pelo pela pelos pelas até isso isto entre era depois sem mesmo ter quem me esse essa esses eu você tinha foram numa num nem meu minha às têm havia seja qual será nós tenho lhe deles essas este esta estes fosse dele tu te vocês são ainda ano anos dia tempo vida mundo homem mulher casa cidade água trabalho grupo pergunta parte vez vezes bem embora enquanto ninguém cada quase agora perto junto segundo durante contra desde onde porque pouco poucos tudo todos toda todas outro outra outros outras dois duas três ser estar fazer disse pode podem deve não há nada nenhum sempre nunca primeiro grande melhor última novo",
}
# Older three-letter codes that differ from the newer ones.
OLD_CODES = {"ger": "de", "fre": "fr", "dut": "nl", "chi": "zh", "cze": "cs", "gre": "el", "per": "fa", "rum": "ro", "slo": "sk", "wel": "cy", "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "geo": "ka", "ice": "is", "mac": "mk", "may": "ms"}
# The languages' own names, folded.
OWN_NAMES = {"deutsch": "de", "francais": "fr", "espanol": "es", "castellano": "es", "castilian": "es", "italiano": "it", "portugues": "pt"}

_KEEP = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz\n" else 32 for b in range(256))
_MARKS = re.compile("[̀-ͯ]+")


def folded_bytes(text: str) -> bytes:
    """Lower-case letters without accents, single bytes; everything else but line feeds becomes a space."""
    text = text.lower()
    if not text.isascii():
        text = text.replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.encode("ascii", "replace").translate(_KEEP)


def _array(data: bytes) -> np.ndarray:
    """Bytes with runs of spaces made one; a line feed swallows the spaces around it."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return a
    gap = a <= 32
    before = np.concatenate([[True], gap[:-1]])
    keep = ~(gap & before) | (a == 10)
    return a[keep]


class _Table:
    """Grams of one length to their rows: a direct table, and a sorted list of those it has no room for."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self._fill()

    def __getstate__(self):
        return self.keys

    def __setstate__(self, keys):
        self.keys = keys
        self._fill()

    def _fill(self) -> None:
        keys = self.keys
        self.slots = np.zeros(1 << self.BITS, np.int32)
        at = self._slot(keys)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        lost = self.slots[at] != np.arange(len(keys))
        self.rest = np.flatnonzero(lost).astype(np.int32)
        self.rest_keys = keys[self.rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        row = self.slots[self._slot(keys)]
        miss = np.flatnonzero(self.keys[row] != keys)
        if len(miss):
            wanted = keys[miss]
            row[miss] = -1
            if len(self.rest):
                at = np.minimum(np.searchsorted(self.rest_keys, wanted), len(self.rest) - 1)
                hit = self.rest_keys[at] == wanted
                row[miss[hit]] = self.rest[at[hit]]
        return row


class Model:
    """Frozen context statistics of several languages."""

    def __init__(self, texts: dict[str, bytes], order: int = ORDER):
        self.languages, self.order = tuple(texts), order
        n = len(texts)
        arrays = {k: _with_lead(_array(v.replace(b"\n", b" ")), order) for k, v in texts.items()}
        self.tables: list[_Table] = []
        self.bits: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        shorter = None
        for m in range(1, order + 2):
            grams = [np.unique(_keys(a, m, order), return_counts=True) for a in arrays.values()]
            union = np.unique(np.concatenate([g for g, _ in grams])) if grams else np.empty(0, np.uint64)
            table = _Table(union)
            counts = np.zeros((len(union), n))
            for j, (g, c) in enumerate(grams):
                counts[np.searchsorted(union, g), j] = c
            # totals and kinds of continuation of each context, the first m - 1 bytes
            context, start = np.unique(union >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, start, axis=0) if len(union) else counts
            kinds = np.add.reduceat((counts > 0).astype(float), start, axis=0) if len(union) else counts
            of = np.searchsorted(context, union >> np.uint64(8))
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(counts / (total + kinds)[of])
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            if m == 1:
                below = np.full((len(union), n), 8.0)
                self.start_escape = escape[0] if len(escape) else np.zeros(n)
            else:
                below = shorter[self.tables[-1].rows(union & np.uint64((1 << (8 * (m - 1))) - 1))]
                # a context is a gram of length m - 1: its price of escaping stands with that gram
                price = np.zeros((len(self.tables[-1].keys), n), np.float32)
                price[self.tables[-1].rows(context)] = escape
                self.escapes.append(price)
            bits = np.where(counts > 0, seen, escape[of] + below)
            self.tables.append(table)
            self.bits.append(bits.astype(np.float32))
            shorter = bits

    def code_lengths(self, a: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language; the text must begin with ``order`` leading spaces, which have no row."""
        out = np.zeros((len(a) - self.order, len(self.languages)), np.float32)
        if not len(out):
            return out
        left = None
        for m in range(self.order + 1, 0, -1):
            keys = _keys(a, m, self.order)
            keys = keys if left is None else keys[left]
            rows = self.tables[m - 1].rows(keys)
            hit = rows >= 0
            if left is None:
                if hit.all():
                    return self.bits[m - 1][rows]
                out[hit] = self.bits[m - 1][rows[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] += self.bits[m - 1][rows[hit]]
                left = left[~hit]
            if not len(left):
                return out
            missed = keys[~hit]
            if m > 1:
                contexts = self.tables[m - 2].rows(missed >> np.uint64(8))
                known = contexts >= 0
                out[left[known]] += self.escapes[m - 2][contexts[known]]
        out[left] += self.start_escape + np.float32(8.0)
        return out


def _with_lead(a: np.ndarray, order: int) -> np.ndarray:
    return np.concatenate([np.full(order, 32, np.uint8), a, [np.uint8(32)]]).astype(np.uint8)


def _keys(a: np.ndarray, m: int, order: int) -> np.ndarray:
    """The ``m`` bytes that end in each byte behind the lead, as one number."""
    wide = a.astype(np.uint64)
    n = len(a) - order
    key = wide[order - m + 1 : order - m + 1 + n].copy()
    for j in range(m - 2, -1, -1):
        key <<= np.uint64(8)
        key |= wide[order - j : order - j + n]
    return key


def word_costs(model: Model, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each word in each language, number of the line of each word)."""
    a = _array(folded_bytes("\n".join(x.replace("\n", " ") for x in lines)))
    feeds = a == 10
    padded = _with_lead(np.where(feeds, np.uint8(32), a), model.order)
    bits = model.code_lengths(padded)[:-1]
    letter = a > 32
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64)
    line = np.cumsum(feeds)[starts]
    return np.add.reduceat(bits, starts, axis=0), line


def path(costs: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The cheapest language of each word of a line, a change of language costing ``change`` bits."""
    # rows have a handful of numbers, for which lists are faster than arrays
    rows = costs.astype(float).tolist()
    cost = rows[0]
    back: list[list[int] | None] = []
    for row in rows[1:]:
        low = min(cost)
        switch = low + change
        if max(cost) <= switch:
            back.append(None)  # each language stays
            cost = [c + x for c, x in zip(cost, row)]
        else:
            best = cost.index(low)
            back.append([j if c <= switch else best for j, c in enumerate(cost)])
            cost = [(c if c <= switch else switch) + x for c, x in zip(cost, row)]
    at = cost.index(min(cost))
    out = np.empty(len(rows), np.int8)
    out[-1] = at
    for i in range(len(back) - 1, -1, -1):
        if (came := back[i]) is not None:
            at = came[at]
        out[i] = at
    return out


def confidence(costs: np.ndarray, words: int) -> float:
    """Posterior of the cheapest language under equal priors, by the mean evidence of ``EVIDENCE`` words.

    Whole code lengths would make any text longer than a line certain, since neighbouring bytes
    are no independent witnesses; the mean says how well the text as a whole is told apart.
    """
    scale = min(1.0, EVIDENCE / max(1, words))
    return float(1.0 / np.exp2(np.maximum(-1000.0, (costs.min() - costs) * scale)).sum())


def is_other(costs: np.ndarray, words: int) -> bool:
    """Whether a text is in none of the languages: dear in all of them, and about as dear in two. Short texts never are."""
    if words < OTHER_WORDS:
        return False
    best, second = np.sort(costs)[:2] / words
    return bool(best > OTHER_BITS and second - best < OTHER_MARGIN)


_SPEAKS = re.compile(r"(?:\S+\s+){%d}\S" % (LINE_WORDS - 1))
_SEPARATORS = re.compile(r" [|·•/›»>–] ")


def page_lines(content: str) -> list[tuple[int, str]]:
    """(line number, line) of the lines that speak for a page: those of several words that are no menu; all lines if there is none."""
    lines = [(no, line) for no, line in enumerate(content.split("\n"), 1) if line and not line.isspace()]
    long = [(no, line) for no, line in lines if len(line) >= 30 and _SPEAKS.search(line) and len(_SEPARATORS.findall(line[:200])) < 3]
    return long or lines


#: Number that stands for a language that the model does not know; it is written ``und``.
OTHER = -2


def stretches(content: str) -> list[tuple[int, str, bool]]:
    """(line number, line, whether it speaks for the page) of all lines but menus; a passage may run over several short ones."""
    speaking = dict(page_lines(content))
    out = []
    for no, line in enumerate(content.split("\n"), 1):
        if line and not line.isspace() and (no in speaking or len(_SEPARATORS.findall(line[:200])) < 3):
            out.append((no, line, no in speaking))
    return out


def judge(model: Model, contents: list[str]) -> list[tuple[int, float, list[tuple[int, int, int, int, float]]]]:
    """For each page: (language, confidence, segments); the language is -1 without any letter, ``OTHER`` if it is none of the model's.

    Segments (line number, first word, words, language, confidence) come for the lines of pages where a
    stretch of words fits another language better.
    """
    chosen = [stretches(c) for c in contents]
    lines = [line for page in chosen for _, line, _ in page]
    owner = np.repeat(np.arange(len(contents)), [len(p) for p in chosen])
    numbers = np.array([no for page in chosen for no, _, _ in page], np.int64)
    speaks = np.array([x for page in chosen for _, _, x in page], bool)
    k = len(model.languages)
    sums = np.zeros((len(contents), k))
    words_of = np.zeros(len(contents), np.int64)
    costs, line_of = word_costs(model, lines)
    if len(costs):
        line_of = np.minimum(line_of, len(lines) - 1)
        loud = speaks[line_of]
        word_page = owner[line_of]
        words_of = np.bincount(word_page[loud], minlength=len(contents))
        for j in range(k):
            sums[:, j] = np.bincount(word_page[loud], costs[loud, j], len(contents))
    main = np.where(sums.any(axis=1), sums.argmin(axis=1), -1)
    suspects: dict[int, None] = {}
    w = 8
    if len(costs) > w:
        gain = (np.take_along_axis(costs, main[word_page][:, None], axis=1) - costs).astype(np.float64)
        sliding = np.cumsum(np.vstack([np.zeros((1, k)), gain]), axis=0)
        over = (sliding[w:] - sliding[:-w]).max(axis=1) > CHANGE
        same = word_page[w - 1 :] == word_page[: -w + 1]
        suspects = dict.fromkeys(word_page[: -w + 1][over & same].tolist())
    bounds = np.searchsorted(word_page, np.arange(len(contents) + 1)) if len(costs) else np.zeros(len(contents) + 1, np.int64)
    out = []
    for p in range(len(contents)):
        segments = []
        if p in suspects:
            total = np.zeros(k)
            own, at = costs[bounds[p] : bounds[p + 1]], line_of[bounds[p] : bounds[p + 1]]
            way = np.empty(len(own), np.int8)
            long = speaks[at]
            # a line that speaks has a way of its own; short lines next to each other share one
            parts = np.flatnonzero(np.diff(np.where(long, at, -1))) + 1
            for lo, hi in zip([0, *parts], [*parts, len(own)]):
                way[lo:hi] = path(own[lo:hi])
            cuts = np.flatnonzero((np.diff(way) != 0) | (np.diff(at) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(way)]):
                segments.append((int(numbers[at[lo]]), int(lo - np.searchsorted(at, at[lo])), int(hi - lo), int(way[lo]), confidence(own[lo:hi].sum(axis=0), int(hi - lo))))
                if long[lo]:
                    total[way[lo]] += hi - lo
            if total.any():
                main[p] = int(total.argmax())
        sure = confidence(sums[p], int(words_of[p])) if main[p] >= 0 else 0.0
        if main[p] >= 0 and is_other(sums[p], int(words_of[p])):
            main[p], segments = OTHER, []
        out.append((int(main[p]), sure, segments))
    return out


def passages(segments: list[dict], least: int = 15) -> list[str]:
    """The languages of at least ``least`` words in a row; a stretch goes on over a line's end if the next segment begins the next line read."""
    found: dict[str, None] = {}
    lang, words = None, 0
    for s in segments:
        # what goes on over a line's end must be plain on either side
        words = words + s["n_words"] if s["lang"] == lang and s["confidence"] >= PLAIN else s["n_words"]
        lang = s["lang"]
        if words >= least:
            found[lang] = None
    return list(found)


def known_codes(spark: SparkSession) -> dict[str, str]:
    """Folded codes and English names of all languages the Java runtime knows, to two-letter codes (some hundreds)."""
    locale = spark._jvm.java.util.Locale
    table = dict(OLD_CODES) | OWN_NAMES
    english = locale.forLanguageTag("en")
    for code in locale.getISOLanguages():
        one = locale.forLanguageTag(code)
        names = [code, one.getDisplayLanguage(english)]
        try:
            names.append(one.getISO3Language())
        except Exception:  # noqa: BLE001, S110  a code without a three-letter form
            pass
        for name in names:
            folded = folded_bytes(name).decode().strip()
            if folded:
                table.setdefault(folded, code)
    for code in LANGUAGES:
        table[code] = code
    return table


def label_codes(label: str | None, known: dict[str, str]) -> set[str]:
    """The languages that a label names, with or without regions."""
    found = set()
    for entry in re.split(r"[,;|]", label or ""):
        folded = unicodedata.normalize("NFKD", entry.strip().lower())
        folded = _MARKS.sub("", folded)
        for name in (folded, re.split(r"[-_ (]", folded)[0]):
            if name in known:
                found.add(known[name])
                break
    return found


def label_column(label: Column, known: dict[str, str]) -> Column:
    """The first language of a label, by the leading letters of its first entry."""
    head = F.lower(F.regexp_extract(label, "^\\s*([A-Za-z]+)", 1))
    return F.create_map(*[x for k, v in known.items() if v in LANGUAGES and k.isalpha() for x in (F.lit(k), F.lit(v))])[head]


def fit(df: DataFrame, key: str, label: str, content: str, sample: int = SAMPLE) -> Model:
    """The model from a bounded sample of labelled rows and the seed texts.

    Rows are chosen by a hash of ``key``, with for each language the chance that yields about
    ``sample`` of them. Without usable rows the seed texts stand alone.
    """
    known = known_codes(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("key"), label_column(F.col(f"`{label}`"), known).alias("lang"), F.col(f"`{content}`").alias("content"))
    rows = rows.filter("lang IS NOT NULL AND content IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # six rows
    seeds = {k: folded_bytes(v) for k, v in SEEDS.items()}
    if not counts:
        return Model(seeds)
    million = 1_000_000
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * million)))])[F.col("lang")]
    drawn = rows.filter(F.pmod(F.xxhash64("key"), F.lit(million)) < chance).select("lang", "content")
    drawn = drawn.orderBy(F.xxhash64("content")).limit(2 * sample * len(LANGUAGES)).collect()
    first = Model({k: (v + b" ") * 2 for k, v in seeds.items()}, order=3)
    pool = {k: [v] for k, v in seeds.items()}
    texts = [r["content"] for r in drawn]
    for lo in range(0, len(texts), 200):
        part = texts[lo : lo + 200]
        chosen = [" ".join(line for _, line in page_lines(t)) for t in part]
        costs, line = word_costs(first, chosen)
        sums = np.zeros((len(part), len(LANGUAGES)))
        np.add.at(sums, np.minimum(line, len(part) - 1), costs)
        for i, text in enumerate(chosen):
            if sums[i].any() and LANGUAGES[int(sums[i].argmin())] == drawn[lo + i]["lang"] and sum(map(len, pool[drawn[lo + i]["lang"]])) < SAMPLE_CHARS:
                pool[drawn[lo + i]["lang"]].append(folded_bytes(text))
    # mixed rows teach the wrong language: the second pass drops rows with a foreign stretch
    model = Model({k: b" ".join(v) for k, v in pool.items()})
    clean = {k: [v[0]] for k, v in pool.items()}
    for j, (k, v) in enumerate(pool.items()):
        for text in v[1:]:
            costs, _ = word_costs(model, [text.decode()])
            if len(costs) > 8:
                sliding = np.cumsum(np.vstack([np.zeros((1, len(LANGUAGES))), costs[:, j : j + 1] - costs]), axis=0)
                if (sliding[8:] - sliding[:-8]).max() <= 6.0:
                    clean[k].append(text)
    return Model({k: b" ".join(v) for k, v in clean.items()})


def languages(df: DataFrame, key: str, label: str, content: str, model: Model | None = None) -> DataFrame:
    """(key, label, lang, confidence, segments) of every row with content that is not blank.

    ``segments`` is an array of (line_no, first_word, n_words, lang, confidence), filled for pages with
    a stretch in another language. ``lang`` is null for contents without any Latin letter, ``und`` for texts in none of the model's languages,
    whose confidence is that of the nearest one.
    """
    sc = df.sparkSession.sparkContext
    sent = sc.broadcast(model or fit(df, key, label, content))
    part = pa.list_(pa.struct([("line_no", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        name = model.languages
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, sure, parts, lo = [], [], [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 400_000):
                    size += len(texts[hi])
                    hi += 1
                for main, c, segments in judge(model, texts[lo:hi]):
                    langs.append(name[main] if main >= 0 else "und" if main == OTHER else None)
                    sure.append(c)
                    parts.append([{"line_no": a, "first_word": b, "n_words": n, "lang": name[s], "confidence": x} for a, b, n, s, x in segments])
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(parts, part)], names=["key", "label", "lang", "confidence", "segments"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{content}`").alias("content")).filter("content RLIKE '\\\\S'")
    return rows.mapInArrow(run, f"key {kind}, label string, lang string, confidence double, segments array<struct<line_no: bigint, first_word: int, n_words: int, lang: string, confidence: double>>")


def label_issues(df: DataFrame, key: str, label: str, content: str, *, without: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(key, issue, lang): labels that are missing or wrong, and passages of at least ``PASSAGE`` words in another language.

    Pages with null, empty or blank content, or in a language that the model does not know, have no row, nor have those of ``without`` (column ``doc``).
    """
    known = known_codes(df.sparkSession)
    judged = languages(df, key, label, content, model).filter("lang <> 'und'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, issues, langs = [], [], []
            for i, (label_, lang, segments) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                named = label_codes(label_, known)
                if not named or lang not in named:
                    at.append(i)
                    issues.append("wrong" if named else "missing")
                    langs.append(lang)
                for other in [x for x in passages(segments, PASSAGE) if x != lang]:
                    at.append(i)
                    issues.append("mixed")
                    langs.append(other)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(issues, pa.string()), pa.array(langs, pa.string())], names=["key", "issue", "lang"])

    kind = df.schema[key].dataType.simpleString()
    found = judged.select("key", "label", "lang", "segments").mapInArrow(run, f"key {kind}, issue string, lang string")
    if without is not None:
        found = found.join(without.select(F.col("doc").alias("key")), "key", "left_anti")
    return found
