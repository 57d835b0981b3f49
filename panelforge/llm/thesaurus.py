"""Expressions of one meaning in the scales that surveys use, in English and French.

General language, not the wording of any one table: each line has expressions that can stand for one another,
as folded words; # is any number. A caller may pass lines of its own.
"""

from __future__ import annotations

import re

LINES = """
daily; every day; each day; all the time
one; 1; once
two; 2; twice
three; 3
four; 4
five; 5
six; 6
seven; 7
eight; 8
nine; 9
ten; 10
weekly; once a week; every week; per week; a week
monthly; once a month; every month; per month; a month
yearly; annually; once a year; per year; a year
a few; several; # or #; # #; #x
rarely; seldom; hardly ever
never; not ever; not once
often; frequently; regularly
yes; yeah; yep; yup; sure; of course
no; nope; nah; no way
dont know; dunno; no idea; not sure; no clue; do not know
prefer not to say; rather not say
undecided; not decided yet; not decided; have not made up my mind; unsure
neither; neutral; in the middle; no opinion either way
neither agree nor disagree; neutral; in the middle; on the fence
strongly; totally; completely; fully; entirely; absolutely; wholly
somewhat; a little; a bit; slightly; to some extent; partly; kind of
very; extremely; really; highly
very satisfied; happy; delighted; extremely happy
fairly; reasonably; quite; rather; somewhat; pretty
not very; not that; not so; not particularly; not too
not at all; zero; none; in no way
no trust at all; zero trust; none; none whatsoever; no trust
a great deal of; lots of; a lot of; plenty of; much
quite a lot of; a fair amount of; a good deal of; some
not very much; little; not much
moderately; fairly; reasonably
slightly; of small; of little; a little
extremely important; of the utmost importance; crucial; vital; essential
moderately important; fairly important; of medium importance; mid level
slightly important; of small importance; of little importance; of minor importance
not important at all; unimportant; of no importance; irrelevant
much more; a lot more; far more; way more
much less; a lot less; far less; way less; cut deeply; cut it deeply
about the same; where it is; the same; as now; unchanged
spend; spending
gotten better; improved; better now; is better
stayed about the same; unchanged; no change; the same
gotten worse; deteriorated; worse now; is worse; declined
certain; for sure; definitely; surely; will vote
likely; probably; ill probably; i will probably
unlikely; probably wont; probably not; i doubt
already voted in advance; voted early; advance poll; advance voting
spoil my ballot; spoiled ballot; spoilt ballot
bus; transit; public transit; public transport
metro; subway; underground; transit; public transit; public transport
bus or metro; transit; public transit; public transport; the bus; the metro; the subway
my own car; my car; own vehicle; my vehicle; own car
car; vehicle; auto; automobile; i drive
bicycle; bike; by bike; cycling; i cycle; cycle
on foot; walking; i walk; walk; by walking
carpool; carpooling; shared ride; ride sharing; ride share
nurse or care aide; nurse; registered nurse; care aide; caregiver; nursing
school teacher; teacher; i teach; teach; teaching
truck or bus driver; trucker; truck driver; bus driver; drive a bus; drive a city bus; drive a truck
software developer; programmer; web developer; coder; dev; developer; software engineer
electrician or plumber; electrician; plumber; licensed plumber
retired; retiree; pensioner; on a pension
student; undergrad; undergraduate; studying; in school; studies; studying full time
municipal council; municipality; city; city hall; the city; town; town hall
regional board; region; the region
provincial government; province; the province
federal government; feds; the feds; ottawa
social networks; social media; social feeds
un; 1
deux; 2
trois; 3
quatre; 4
cinq; 5
six; 6
sept; 7
huit; 8
neuf; 9
dix; 10
tous les jours; chaque jour; quotidiennement; quotidien
par semaine; chaque semaine; hebdomadairement; la semaine
par mois; une fois par mois; mensuellement; chaque mois
par annee; par an; lan; annuellement; chaque annee
quelques; plusieurs; # ou #; deux ou trois
rarement; presque jamais
jamais; pas une fois; pas une seule fois
souvent; frequemment; regulierement
oui; ouais; mais oui; bien sur
non; nenni; pas du tout; que non
je ne sais pas; je sais pas; jsais pas; aucune idee; pas certain; chais pas
prefere ne pas dire; prefere ne pas repondre
indecis; pas decide; pas encore decide; pas encore decidee; indecise
ni daccord ni en desaccord; neutre; entre les deux; au milieu; sans opinion
tout a fait; completement; totalement; entierement; absolument
tout a fait daccord; # daccord
strongly agree; agree #; i agree #
plutot; assez; un peu; quelque peu
tres; vraiment; extremement
tres satisfait; content; vraiment content; tres content; ravi
peu; pas tres; pas tellement; pas vraiment; guere
pas du tout; aucunement; zero; aucune; aucun; insatisfait total
pas du tout satisfait; aucune satisfaction; insatisfait
aucune; zero; pas de
une grande; beaucoup de; enormement de
pas mal de; assez de; une bonne
pas beaucoup de; peu de
extremement; dune extreme; vitale; cruciale
extremement important; dune importance extreme; crucial; essentiel
moyennement important; dimportance moyenne
legerement important; de faible importance; de peu dimportance
pas du tout important; sans importance; aucune importance
beaucoup plus; bien plus; nettement plus
beaucoup moins; bien moins; nettement moins
autant; le meme niveau; pareil; meme niveau
depenser; depenses; garder
depenser a peu pres autant; garder le meme niveau
sest amelioree; ca va mieux; mieux; amelioration
est restee a peu pres pareille; aucun changement; pareil; inchangee; stable
sest deterioree; ca va plus mal; pire; empire; plus mal
certain de voter; vais voter; cest sur; voter cest sur
susceptible; probablement; sans doute
susceptible de voter; vais probablement voter; voterai probablement
peu susceptible de voter; ne voterai probablement pas; probablement pas
deja vote par anticipation; vote davance; vote par avance
jannulerais mon bulletin; bulletin annule; annuler mon bulletin
autobus ou metro; transport en commun; transports en commun; lautobus; le metro; bus
ma propre voiture; ma voiture; mon auto; mon char
voiture; auto; vehicule; char
velo; bicyclette; en velo; a velo
a pied; en marchant; je marche; marche
covoiturage; auto partagee; voiture partagee
infirmiere ou prepose aux soins; infirmiere; infirmier; prepose; preposee; prepose aux beneficiaires
enseignant; prof; professeur; enseignante; jenseigne
conducteur de camion ou dautobus; camionneur; camionneuse; chauffeur; chauffeur dautobus; conducteur
developpeur de logiciels; programmeur; programmeuse; developpeur; developpeuse; informaticien
electricien ou plombier; electricien; plombier; electricienne; plombiere
retraite; retraitee; pensionne; pensionnee; rentier
etudiant; etudiante; aux etudes; cegepien
conseil municipal; ville; la ville; municipalite; mairie; lhotel de ville
regie regionale; region; la region
gouvernement provincial; province; la province
gouvernement federal; federal; le federal; ottawa
reseaux sociaux; medias sociaux; les reseaux
"""


class Thesaurus:
    """Groups of expressions of one meaning."""

    def __init__(self, text: str = LINES):
        self.groups = [[tuple(x.split()) for x in line.split("; ")] for line in text.strip().splitlines() if line != "="]
        #: by first word, the places of expressions
        self.starting: dict[str, list[tuple[int, int]]] = {}
        for g, group in enumerate(self.groups):
            for k, x in enumerate(group):
                self.starting.setdefault(x[0], []).append((g, k))

    def within(self, vocabulary) -> "Rewriter":
        """The expressions that some words of the vocabulary can stand for."""
        by_first: dict[str, list[tuple[tuple[str, ...], list[tuple[str, ...]]]]] = {}
        there: dict[int, list[int]] = {}
        for g, k in sorted(p for w in vocabulary for p in self.starting.get(w, ())):
            if all(w in vocabulary for w in self.groups[g][k]):
                there.setdefault(g, []).append(k)
        for g, places in there.items():
            known = [self.groups[g][k] for k in places]
            for own in self.groups[g]:
                if others := [x for x in known if x != own]:
                    by_first.setdefault(own[0], []).append((own, others))
        for found in by_first.values():
            found.sort(key=lambda x: -len(x[0]))
        return Rewriter(by_first)


class Rewriter:
    """Puts expressions in the words of one vocabulary."""

    def __init__(self, by_first: dict[str, list[tuple[tuple[str, ...], list[tuple[str, ...]]]]]):
        self.by_first = by_first
        self.numbered = any("#" in w for w in by_first)

    def __call__(self, ws: list[str]) -> list[list[str]]:
        """ws with one, or every, expression put in words of the vocabulary."""
        if not self.numbered and self.by_first.keys().isdisjoint(ws):
            return []
        spots, one = [], []
        for plain in (ws, [re.sub(r"\d+", "#", w) for w in ws] if any(w[0].isdigit() for w in ws) else None):
            for i, w in enumerate(plain or ()):
                for own, others in self.by_first.get(w, ()):
                    if len(own) > 1 and tuple(plain[i : i + len(own)]) != own:
                        continue
                    for other in others:
                        one.append([*ws[:i], *other, *ws[i + len(own) :]])
                        spots.append((i, len(own), other))
        if len({i for i, _, _ in spots}) > 1:  # the longest at each place, from the left, without overlaps
            spots.sort(key=lambda x: -x[1])
            out, i = [], 0
            while i < len(ws):
                here = next(((n, x) for at, n, x in spots if at == i), None)
                out += here[1] if here else (ws[i],)
                i += here[0] if here else 1
            one.append(out)
        return one
