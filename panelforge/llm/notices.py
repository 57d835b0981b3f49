"""Grammars of notices, error pages and filler, and of sentences that only talk about them (problem 9).

General language of the web, put together at random. FAMILIES can be left out one by one, to measure how a
family is found that training has not seen.
"""

from __future__ import annotations

import random

from panelforge.llm.seeds import grammar

FAMILIES = {
    "scripts": grammar("""
text: {please} {enable} {script} {goal}. | {please} {enable} {script}. | {script} {is} {off}{where}. | {thing} {needs} {script} {goal}. | {thing} {needs} {script}. | {browser} {cannot} {script}. | {browser} {cannot} {script}, or {they}. | We're sorry, but {thing} {broken} without {script} {on}. | Checking {browser} before {opening}... | Verifying that you are human. | {veuillez} {activer} {lescripts} {pour}. | {lescripts} {est} {coupe}. | {chose} a besoin de {lescripts} {pour}. | {chose} exige {lescripts}. | {activez} {lescripts}, puis {reload}. | Votre navigateur {nepas} {lescripts}.
please: Please | You need to | You must | You have to | To continue, | Kindly | Sorry, you must
enable: enable | turn on | activate | allow | switch on | accept | unblock
script: JavaScript | scripts | scripting | cookies | JavaScript and cookies | Java scripts | active scripts
goal: to continue | to view this page | to view this content | to use this site | to see the form | before you can go on | and reload | and try again | to proceed
is: is | seems | appears | are
off: disabled | required | turned off | blocked | not enabled | not supported | needed here
where: _ | in your browser | on this device | for this site
thing: This site | This page | This form | The application | This content | The app | this form | this app
needs: requires | needs | works only with | depends on | will not load without
browser: Your browser | This browser | your browser
cannot: does not support | does not run | has disabled | blocks | cannot run | refuses | doesn't allow
they: they were blocked | it was turned off | they are off
broken: doesn't work properly | won't work | cannot be shown | does not load
on: enabled | turned on | _
opening: accessing the page | you continue | loading the site
veuillez: Veuillez | Vous devez | Merci de | Il faut
activer: activer | autoriser | accepter | débloquer
activez: Activez | Autorisez | Acceptez
lescripts: JavaScript | les scripts | les témoins | les cookies | les scripts et les témoins
pour: pour continuer | pour afficher cette page | pour fonctionner correctement | afin de voir le contenu | pour utiliser ce site
est: est | semble | sont
coupe: désactivé | requis | désactivés | bloqué | nécessaires
chose: Ce site | Cette page | Ce formulaire | L'application
reload: rechargez | réessayez | actualisez la page
nepas: n'exécute pas | ne prend pas en charge | bloque | refuse
"""),
    "session": grammar("""
text: {your} {session} {over}. | {your} {session} {over}. {again}. | {votre} {seance} {fini}. | {votre} {seance} {fini}. {encore}.
your: Your | The | This | Your secure
session: session | login | connection | sign-in | visit
over: has expired | expired | timed out | has ended | was closed | is no longer valid | was reset
again: Please log in again | Sign in to continue | Please reconnect | Log in once more
votre: Votre | La
seance: session | connexion | séance
fini: a expiré | est expirée | est terminée | a été fermée | n'est plus valide | a été réinitialisée
encore: Veuillez vous reconnecter | Reconnectez-vous | Ouvrez une nouvelle session
"""),
    "server": grammar("""
text: {server} {met} {trouble}. | {oops} went wrong{ours}. | {server} is {away}. {later}. | {server} is {away}. | upstream {x} {failed} | {x} {failed} | {too}. {slow}. | {serveur} {rencontre} {souci}. | {serveur} est {absent}, {retard}. | Une erreur {sorte} est survenue. | Une erreur {sorte} s'est produite{nous}. | {site} can't be reached. | {site} took too long to respond. | The connection {lost}. | Unable to connect to {server}. | {trop}. {lent}.
server: The server | Our server | The service | This service | The host | The gateway | the database
met: encountered | ran into | returned | reported | met
trouble: an unexpected condition | an internal error | an error | a problem and could not complete your request | a temporary error
oops: Something | Oops! Something | Sorry, something | Whoops, something
ours: _ | on our end | on our side | while loading the page | . Please try again
away: unavailable | temporarily unavailable | down for maintenance | under maintenance | overloaded | not responding | offline
later: Please try again later | Come back soon | Retry in a few minutes | We'll be back soon
x: request | connection | response | gateway | proxy request | read
failed: timeout | timed out | failed | error | refused | aborted
too: Too many requests | Rate limit exceeded | You are sending requests too fast
slow: Slow down and retry in 20 seconds | Try again later | Wait a minute and try again
serveur: Le serveur | Notre serveur | Le service | La passerelle
rencontre: a rencontré | a renvoyé | signale
souci: une erreur interne | une condition inattendue | un problème temporaire
absent: en maintenance | indisponible | temporairement indisponible | surchargé | hors ligne
retard: revenez plus tard | réessayez plus tard | veuillez patienter
sorte: interne | inattendue | de serveur | technique
nous: _ | de notre côté | pendant le chargement
site: This site | This page | The website | The address
lost: was reset | was lost | was closed | was refused | has timed out
trop: Trop de requêtes | Limite de requêtes dépassée
lent: Réessayez plus tard | Ralentissez et réessayez
"""),
    "missing": grammar("""
text: {page} {gone}. | {sorry} {page} {gone}. | Error 404 - {page} {gone}. | {lapage} {partie}. | Erreur 404 : {lapage} {partie}. | Nothing {here}. | We couldn't find {page}.
sorry: Sorry, | Oops! | We're sorry,
page: the page you requested | the page you are looking for | this page | the requested URL | the content | the requested resource | this file | the link
gone: could not be found | was not found | does not exist | no longer exists | has been removed | has been moved | isn't available | is not here anymore | was not found on this server
lapage: la page demandée | la page que vous cherchez | le contenu demandé | cette page | ce fichier | la ressource demandée
partie: n'existe plus | est introuvable | n'a pas été trouvée | a été déplacé | a été supprimée | n'est plus disponible | n'existe plus ou a été déplacé
here: was found here | to see here
"""),
    "permission": grammar("""
text: {denied}. | {denied}: {you}. | {you}. | {refuse}. | {refuse} : {vous}. | {vous}.
denied: Access denied | Permission denied | Access is denied | Access forbidden | Unauthorized access | Request blocked | Forbidden
you: You do not have permission to view this resource | You don't have permission to access this page | you lack the rights to open this file | you are not authorized to view this page | your IP address has been blocked | you must be logged in to see this
refuse: Accès refusé | Accès interdit | Accès non autorisé | Permission refusée | Requête bloquée
vous: vous n'avez pas les droits requis | vous n'avez pas la permission de voir cette page | vous n'êtes pas autorisé à consulter ce contenu | vous devez être connecté pour voir ceci
"""),
    "crash": grammar("""
text: Fatal error: {what} in {file}.php on line {n} | Traceback (most recent call last): | File "{file}.py", line {n}, in {name} | {kind}: {what} | {kind}: '{name}' | Warning: {what} in /var/www/{file}.php | Exception in thread "main" {kind}: {what} | at {name}.{file}({file}.java:{n}) | Uncaught {kind}: {what} | Segmentation fault (core dumped) | Stack trace: | Undefined {part} {name}
what: Uncaught exception | Undefined variable | Call to undefined function | out of memory | division by zero | index out of range | Cannot read properties of undefined | null is not an object | no such file or directory
file: index | page | main | view | app | template | render
n: 12 | 48 | 107 | 233
name: render | name | title | get_user | load | run
kind: KeyError | ValueError | TypeError | NullPointerException | RuntimeException | IndexError | AttributeError | ReferenceError | SyntaxError
part: index: | variable | property | offset
"""),
    "filler": grammar("""
text: {your} {text} {here}. | {this} {dummy} {text}. | {replace} {this2} before {launch}. | Replace before {launch}. | {dummy} {text} {dummy} {text} {dummy} {text}. | {dummy} {text}. | {votre} {texte} {ici}. | {ceci} {faux} {texte} à {changer} avant {pub}. | {texte2} de remplissage, {texte2} de remplissage. | {texte2} provisoire. | {ecrire} {votre2} {texte} ici. | Coming soon. Content goes here.
your: Your | Insert your | Add your | Enter your | Type your | Put your | Some
text: text | paragraph | title | headline | content | copy | caption | sentence | quote
here: here | goes here | will go here | comes here | to be added | should appear here
this: This is | Here is some | The following is | This block is
this2: this text | this paragraph | the placeholder | this sentence | the sample copy
dummy: dummy | placeholder | sample | filler | example | blind
replace: Replace | Change | Delete | Remove | Swap
launch: launch | publication | going live | publishing | release | print
votre: Votre | Insérer votre | Mettre votre
votre2: votre | le | un
texte: texte | paragraphe | titre | contenu | slogan
texte2: Texte | texte | Contenu
ici: ici | va ici | à venir | à insérer
ceci: Ceci est un | Voici un | Ce bloc est un
faux: faux | exemple de | modèle de
changer: remplacer | changer | supprimer | retirer
pub: publication | la mise en ligne | l'impression | le lancement
ecrire: Écrivez | Tapez | Insérez | Placez
"""),
}

TALK = grammar("""
text: {who} {told} that {site} {did}. | {who} {told} that {site} {did}, {so} {act}. | {site} {did}, {so} {act}. | In {place}, {site} {did} {when}. | {tech}. | {access} {was} to {group}, {says}. | Our {session} {ended} {when}. | {qui} {dit} que {lesite} {fait}. | {qui} {dit} que {lesite} {fait}, alors {agit}. | {lesite} {fait}, alors {agit}. | {acces} aux {groupe}, selon {source}. | La {seance} {fin} {quand}. | {techfr}. | An {error} in {count}, not in any server, explains {gap}. | {printer} {used} {lorem} on {paper}{laugh}.
who: She | He | My father | One reader | A volunteer | The clerk | My neighbour | A panel member | The moderator
told: complained | said | wrote | noted | told us | explained | remembered
site: the web form | the site | the survey page | the booking page | the town's website | the link in the letter | the app
did: kept showing a 404 page | returned an error 500 twice | told people to enable JavaScript | said the page was not found | asked for cookies | was down for maintenance | timed out | said access was denied | showed lorem ipsum | had expired
so: so | and | while
act: they phoned instead | she gave up | all they wanted was a timetable | we used paper | nobody could vote online
place: the second wave | the meeting | the report | the pilot
when: twice | during the debate | last week | before the vote | at noon
tech: In the software a field is written with curly braces and gets replaced by a name | The code list marks missing answers with brackets | Words such as [laughs] or [pause] mark reactions | A placeholder such as the name of the town is filled in later by the program | The term lorem ipsum comes from a printer's trade | Error pages were a topic of the training | JavaScript was the language of the course
access: Access | Entry | Permission
was: was denied | was refused | was not granted
group: observers | reporters | the volunteers | residents
says: says the report | according to the minutes | the clerk wrote
session: session | meeting | connection
ended: expired twice | ended early | was reset
error: internal error | unexpected error | error
count: the count | the tally | the sample | the weights
gap: the gap | the difference | the missing ballots
printer: The printer | A designer | The intern
used: used | had put | left
lorem: lorem ipsum | dummy text | filler text | placeholder text
paper: the mock ballot | the poster draft | the sample page
laugh: _ | , and everyone laughed | , which nobody saw
qui: Elle | Il | Mon père | Une lectrice | Le greffier | Une bénévole
dit: s'est plainte | a dit | a écrit | raconte | se souvient
lesite: le formulaire | le site | la page du sondage | le site de la ville | le lien de la lettre
fait: affichait toujours une page 404 | renvoyait une erreur 500 | exigeait JavaScript | demandait les témoins | était en maintenance | disait que la page était introuvable | refusait l'accès | avait expiré
agit: on a téléphoné | elle a abandonné | il voulait seulement un horaire | on a pris du papier
acces: L'accès a été refusé | L'entrée a été refusée | La permission n'a pas été donnée
groupe: observateurs | journalistes | bénévoles | résidents
source: le procès-verbal | le rapport | la greffière
seance: session | séance | réunion
fin: a expiré deux fois | s'est terminée tôt | a été interrompue
quand: durant le débat | la semaine passée | avant le vote
techfr: Un champ inséré s'écrit entre accolades et il est remplacé par un nom | Les crochets comme [rires] notent les réactions | L'imprimeur avait mis du faux texte latin sur le bulletin d'exemple | Le faux texte amusait tout le monde | Les pages d'erreur faisaient partie de la formation
""")

_HEADS = "do lo ip su am con sec adi pis el it sed ei us tem por in cid la bo ma gna al qua mi ve ni quis nos tru ex er ci ta ti ul lam co ris nis ali quip com mo con se du aut iru re pre hen de rit vo lup ta te ve lit es se cil fu gi nul pa ri tur".split()
_ENDS = "um us is it at ant ent a e o or et em am unt ur que ibus ae".split()
_SMALL = "sed et in ut ad non est qui cum per ex de ab".split()


def latin(rng: random.Random) -> str:
    """A sentence of made Latin words, as filler has them."""
    ws = [
        rng.choice(_SMALL) if rng.random() < 0.2 else "".join(rng.choice(_HEADS) for _ in range(rng.randrange(1, 4))) + rng.choice(_ENDS)
        for _ in range(rng.randrange(4, 12))
    ]
    if rng.random() < 0.5:
        ws[rng.randrange(len(ws) - 1)] += ","
    return " ".join(ws).capitalize() + "."


def repeated(rng: random.Random) -> str:
    """One short word said again and again."""
    w = rng.choice(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 6))), "test", "text", "xxx", "bla", "foo", "sample"])
    return " ".join([w] * rng.randrange(3, 7) + ([str(rng.randrange(9))] if rng.random() < 0.3 else []))


def shaped(rng: random.Random, text: str) -> str:
    """text with its blanks put right, mostly as it is, else all in capitals or without its last mark."""
    text = " ".join(text.split()).replace(" ,", ",").replace(" .", ".")
    text = text[:1].upper() + text[1:]
    return rng.choice([text, text, text, text, text.rstrip("."), text.upper()])
