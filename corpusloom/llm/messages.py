"""A small model that tells messages of machines from ordinary lines.

It is a logistic model over hashed words, word pairs and the 3- to 5-letter parts of
words, so that other wordings, and other languages with kindred words, score too. It learns from the
seeds below and from a bounded number of labelled lines of the data at hand. No line is
looked up in a list: the seeds only teach.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np

FEATURES = 1 << 17
ROUNDS = 40

# Seeds: messages that take the place of a page, by language.
MESSAGES = """
Page not found
Sorry, the page you are looking for does not exist or has moved
We could not find that address on this server
Oops, this link is broken and goes nowhere
Nothing was found here, try a search or go back to the home page
Whatever you were looking for, we looked everywhere and it is no longer here
The requested document is unavailable
There is no such page or story
This link leads to a dead end, the address may be mistyped or the bookmark out of date
Access denied
You are not allowed to see this page
Forbidden: you do not have permission to open this file
Internal server error, reference 17
Something went wrong on our side and our team has been notified
An unexpected error occurred, please try again later
Your request could not be completed, please return to the previous page and retry in a few minutes
This service is temporarily unavailable at the moment
The site is down for maintenance and will be back soon
Bad gateway: the server got an invalid answer
Too many requests, slow down and retry in some seconds
The connection timed out or was refused
Your session has expired, please sign in again
You must log in to continue
Please enable JavaScript in your browser to run this app
This site requires scripts and cookies, turn them on and reload
Checking your browser before opening the site, this may take a few seconds
Loading, please wait
If nothing appears, your browser may block scripts
Are you human? Type the letters you see to prove that you are not a robot
This content has been removed by its author
This video is not available in your country
This domain is parked or for sale, contact the owner
Fatal error: cannot open stream on line 17
Warning: undefined variable, division by zero on line 17
Notice: include of a file failed to open stream
Return to the start page or search this site
Database connection could not be established
{"error": {"code": 17, "message": "no such document"}}
Subscribe to continue reading
Your browser is not supported, please upgrade it
Sample page: replace this with your own content
Your heading here
Click to edit this paragraph and add your own text
Coming soon, this page is under construction
Hello world, welcome to your first post, edit or delete it
Seite nicht gefunden
Die gewünschte Seite wurde leider nicht gefunden oder existiert nicht mehr
Fehler 17
Hoppla, hier gibt es nichts, zurück zur Startseite
Unter dieser Adresse ist kein Inhalt zu finden
Zugriff verweigert, Ihnen fehlt die Berechtigung für diese Seite
Interner Serverfehler, Vorgang 17
Etwas ist schiefgelaufen, bitte versuchen Sie es später erneut
Ihre Anfrage konnte nicht verarbeitet werden
Der Dienst steht wegen Wartungsarbeiten zurzeit nicht zur Verfügung
Zu viele Anfragen, bitte warten Sie einige Sekunden
Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Anwendung zu nutzen
Diese Seite benötigt Skripte und Cookies
Ihr Browser wird geprüft, das dauert einige Sekunden
Wird geladen, bitte warten
Sind Sie ein Mensch? Geben Sie die Zeichen ein
Dieser Inhalt wurde entfernt
Diese Domain steht zum Verkauf
Beispielseite: ersetzen Sie diesen Text durch Ihren eigenen
Page introuvable
La page demandée est introuvable, n'existe plus ou a été déplacée
Erreur 17
Oups, il n'y a rien ici, retour à l'accueil
Accès refusé, vous n'avez pas le droit d'ouvrir cette page
Une erreur interne est survenue, réessayez plus tard
Revenez à la page d'accueil ou faites une recherche
Vérifiez l'adresse ou lancez une autre recherche
Votre demande n'a pas pu être traitée
Service indisponible, site en maintenance, merci de revenir plus tard
Trop de requêtes, veuillez patienter quelques secondes
Votre session a expiré, reconnectez-vous
Activez JavaScript dans votre navigateur pour utiliser cette application
Ce site a besoin des scripts et des cookies, activez-les puis rechargez la page
Vérification de votre navigateur, cela prend quelques secondes
Chargement, veuillez attendre
Êtes-vous humain ? Saisissez les lettres
Ce contenu a été supprimé ou n'est pas disponible dans votre pays
Ce domaine est à vendre
Page d'exemple : remplacez ce texte par le vôtre
Página no encontrada
No se ha encontrado la página solicitada, no existe o se ha movido
Error 17
Vaya, aquí no hay nada, volver al inicio
Acceso denegado, no tiene permiso para abrir esta página
Error interno del servidor, algo ha salido mal, inténtelo de nuevo más tarde
Su solicitud no se ha podido procesar
Servicio no disponible por mantenimiento
Demasiadas solicitudes, espere unos segundos
Su sesión ha caducado, inicie sesión de nuevo
Active JavaScript en su navegador para usar esta aplicación
Este sitio necesita scripts y cookies, actívelos y recargue
Comprobando su navegador, espere unos segundos
Cargando, espere
¿Es usted humano? Escriba las letras
Este contenido ha sido eliminado o no está disponible en su país
Este dominio está en venta
Página de ejemplo: sustituya este texto por el suyo
Pagina non trovata
La pagina richiesta non è stata trovata, non esiste o è stata spostata
Errore 17
Ops, qui non c'è nulla, torna alla pagina iniziale
Accesso negato, non ha il permesso di aprire questa pagina, codice 17
Errore interno del server, qualcosa è andato storto, riprovi più tardi
La sua richiesta non può essere elaborata
Sito in manutenzione, servizio non disponibile
Troppe richieste, attendere qualche secondo
La sessione è scaduta, acceda di nuovo
Attivare JavaScript nel browser per usare questa applicazione
Questo sito richiede gli script e i cookie, li attivi e ricarichi la pagina
Verifica del browser in corso, attendere
Caricamento in corso
È umano? Scriva le lettere che vede
Questo contenuto è stato rimosso
Questo dominio è in vendita
Pagina di esempio: sostituisci questo testo con il tuo
Página não encontrada
A página pedida não foi encontrada, não existe ou foi movida
Erro 17
Ops, não há nada aqui, voltar ao início
Acesso negado, não tem permissão para abrir esta página
Erro interno do servidor, algo correu mal, tente de novo mais tarde
O seu pedido não pôde ser processado
Serviço indisponível para manutenção
Demasiados pedidos, espere alguns segundos
A sua sessão expirou, inicie sessão novamente
Ative o JavaScript no navegador para usar esta aplicação
Este site precisa de scripts e cookies, ative-os e recarregue
A verificar o seu navegador, espere alguns segundos
A carregar, aguarde
É humano? Escreva as letras
Este conteúdo foi removido ou não está disponível no seu país
Este domínio está à venda
Página de exemplo: substitua este texto pelo seu
De opgevraagde pagina is niet gevonden of bestaat niet meer
Toegang geweigerd, probeer het later opnieuw
Sidan kunde inte hittas, gå tillbaka till startsidan
Nie znaleziono takiej strony lub strona nie istnieje
Dostęp zabroniony, spróbuj ponownie później
""".strip().split("\n")  # fmt: skip

# Seeds: ordinary lines, sentences and headings as well as the furniture of pages.
ORDINARY = """
The council approved the new budget on Tuesday evening
The water company measured the level of the river near the old bridge
Three farmers from the valley compared the price of seed
Volunteers counted more birds this spring than in any year before
She has written a history of the harbour and its people
Few readers noticed that the museum had moved its collection
A report on access to water in rural schools
A manual explains how a variable such as <slot> is replaced before a letter is printed
The editors noted that the old message on a missing page had stayed in many drafts
Without scripts the map of the coast showed nothing at all and the authors call it a failure of the design
The servers of the university store forty years of weather records
The page of the manuscript shows a map of the coast
He asked for an error to be corrected in the minutes of the meeting
According to the survey, most residents support the plan
Notes from the annual meeting
The bank funded a study of soil and of old seed
Translators reviewed the policy of the archive and described its rules
The cooperative and the school board rejected the timetable of the ferry
Home
News
Contact us
About this site
Sign in
Terms of use and privacy
Subscribe to our newsletter
By our staff writer
Updated on 17/17/17
Share this article by mail or print
Comments (17)
Most read this week
We use cookies to make this site work better
Der Gemeinderat beschloss am Dienstag den neuen Haushalt
Die Bewohner des Dorfes sammelten Unterschriften für den Bahnhof
Laut der Umfrage unterstützt die Mehrheit den Plan
Die Forscher verglichen alte Karten mit den Werten von heute
Startseite
Kontakt und Impressum
Nutzungsbedingungen
Die meistgelesenen Artikel
Le conseil a adopté le nouveau budget mardi soir
Les habitants de la vallée ont mesuré le niveau de la rivière
Selon l'enquête, la plupart des lecteurs soutiennent le projet
Une histoire du port et de ses métiers
Accueil
Mentions légales
Les articles les plus lus
El ayuntamiento aprobó el nuevo presupuesto el martes
Los vecinos midieron el nivel del río cerca del puente
Según la encuesta, la mayoría apoya el plan
Inicio
Contacto y aviso legal
Lo más leído
Il consiglio ha approvato il nuovo bilancio martedì sera
Gli abitanti della valle hanno misurato il livello del fiume
Secondo il sondaggio, la maggioranza sostiene il progetto
Pagina iniziale
Contatti e condizioni
I più letti
A câmara aprovou o novo orçamento na terça-feira
Os moradores mediram o nível do rio perto da ponte
Segundo o inquérito, a maioria apoia o plano
Início
Contactos e condições
Os mais lidos
De gemeenteraad keurde dinsdag de nieuwe begroting goed
De bewoners van het dorp hebben de oude molen hersteld
Kommunfullmäktige antog budgeten på tisdagen
Rada miasta przyjęła we wtorek nowy budżet
""".strip().split("\n")  # fmt: skip

_MARK = re.compile("[̀-ͯ]+")
_TOKEN = re.compile(r"<\w+>|[^\W\d_]+|\d+|[{}\"]")


def fold(text: str) -> str:
    """Lower case without accents, typographic apostrophes or more than single spaces."""
    text = text.lower()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("’", "'")))
    return " ".join(text.split())


@lru_cache(maxsize=1 << 14)
def _parts(word: str) -> tuple[int, ...]:
    """Places of a word's 3- to 5-letter parts."""
    padded = f"^{word}$"
    return tuple(zlib.crc32(padded[j : j + n].encode()) & (FEATURES - 1) for n in (3, 4, 5) for j in range(len(padded) - n + 1))


def _words(line: str) -> list[str]:
    return ["<n>" if t.isdigit() else t for t in _TOKEN.findall(fold(line))]


def features(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a line; its length has no weight."""
    words = _words(line)
    crc = zlib.crc32
    at: dict[int, float] = {}
    for i, w in enumerate(words):
        for name in ("w" + w, "p" + w + " " + (words[i + 1] if i + 1 < len(words) else "$")):
            k = crc(name.encode()) & (FEATURES - 1)
            at[k] = at.get(k, 0.0) + 1.0
        if w[0] != "<" and len(w) > 2:
            for k in _parts(w):
                at[k] = at.get(k, 0.0) + 0.4
    values = np.fromiter(at.values(), np.float32, len(at))
    if len(values):
        values /= np.sqrt((values * values).sum())
    return np.fromiter(at.keys(), np.int64, len(at)), values


def train(examples: list[tuple[str, int]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights from (line, is a message), by full gradient steps; the classes weigh the same, whatever their numbers. There is no constant: a line of unknown words scores 0."""
    rows = [(*features(line), y) for line, y in examples]
    rows = [r for r in rows if len(r[0])]
    weights = np.zeros(FEATURES, np.float32)
    if not rows:
        return weights
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    y = np.array([r[2] for r in rows], np.float32)
    sizes = np.array([len(r[0]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    used, at = np.unique(at, return_inverse=True)
    share = max(1.0, float(y.sum())) / len(y)
    weigh = np.where(y > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share)).astype(np.float32)
    w = np.zeros(len(used), np.float32)
    squares = np.full(len(used), 1e-2, np.float32)
    for _ in range(rounds):
        z = 4.0 * np.add.reduceat(w[at] * x, starts)
        g = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) * weigh
        step = np.bincount(at, np.repeat(g, sizes) * x, len(used)).astype(np.float32)
        squares += step * step
        w -= 0.25 * step / np.sqrt(squares)
    weights[used] = w
    return weights


def score(weights: np.ndarray, line: str) -> float:
    """Log-odds of a message; 0 for unknown words."""
    at, x = features(line)
    return float(4.0 * (weights[at] * x).sum()) if len(at) else 0.0


class Scorer:
    """Whether lines score more than a bar, without the vector of most of them.

    The sum of the weights is linear in the words, and the norm of a vector is at least that of its entries before those of one place
    are added up, since none is negative; both are known of each word. Only where this bound does not tell is ``score`` worked out.
    """

    #: Room for the rounding of either sum.
    SLACK = 0.01
    #: Words that are kept.
    KEPT = 1 << 16

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._weight: list[float] = weights.tolist()
        self._known: dict[str, tuple[float, float]] = {}

    def _word(self, word: str) -> tuple[float, float]:
        """Weight of a word and its parts, and the square of their values with that of the pair it begins."""
        if len(self._known) >= self.KEPT:
            self._known.clear()
        parts = _parts(word) if word[0] != "<" and len(word) > 2 else ()
        weight = self._weight[zlib.crc32(("w" + word).encode()) & (FEATURES - 1)] + 0.4 * sum([self._weight[k] for k in parts])
        self._known[word] = found = weight, 2.0 + 0.16 * len(parts)
        return found

    def most(self, line: str) -> float:
        """What the line scores at most; not less than 0."""
        words = _words(line)
        weight, known, crc = self._weight, self._known, zlib.crc32
        total = squares = 0.0
        for w, after in zip(words, [*words[1:], "$"]):
            own, square = known.get(w) or self._word(w)
            total += own + weight[crc(f"p{w} {after}".encode()) & (FEATURES - 1)]
            squares += square
        return 4.0 * total / math.sqrt(squares) + self.SLACK if total > 0 else self.SLACK

    def exceeds(self, line: str, bar: float) -> bool:
        return self.most(line) > bar and score(self.weights, line) > bar


_CLAUSE = re.compile(r"[,:;.?!]\s+")


def seed_examples() -> list[tuple[str, int]]:
    """The seeds and, of those with several clauses, each clause."""
    out = []
    for lines, y in ((MESSAGES, 1), (ORDINARY, 0)):
        for line in lines:
            parts = [p for p in _CLAUSE.split(line) if " " in p]
            out += [(p, y) for p in dict.fromkeys([line, *parts])]
    return out


@lru_cache(maxsize=1)
def seed_weights() -> np.ndarray:
    return train(seed_examples())


@lru_cache(maxsize=1)
def seed_scorer() -> Scorer:
    return Scorer(seed_weights())
