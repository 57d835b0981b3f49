"""Grammars from which answers are made for training (problem 2): refusals, asides, reasons and other languages.

They hold general language, put together at random, and no sentence of any table. In a template, each name
in braces is replaced by one of its choices.
"""

from __future__ import annotations

import random
import re

_NAME = re.compile(r"\{(\w+)\}")


def grammar(block: str) -> dict[str, list[str]]:
    """Choices by name, from lines `name: choice | choice`."""
    rules: dict[str, list[str]] = {}
    for line in block.strip().splitlines():
        name, choices = line.split(": ", 1)
        rules.setdefault(name, []).extend(c.replace("_", "") for c in choices.split(" | "))
    return rules


def made(rng: random.Random, rules: dict[str, list[str]], start: str) -> str:
    """One text of the grammar."""
    text = rng.choice(rules[start])
    while "{" in text:
        text = _NAME.sub(lambda m: rng.choice(rules[m.group(1)]), text, count=1)
    return text


#: _ stands for an empty choice.
REFUSALS = {
    "EN": grammar("""
text: {open}{core}{close} | {open}{core}. {more}{close} | {core}{close}
open: _ | Sorry, | Sorry, but | I'm sorry, but | I am sorry; | I apologize, but | My apologies, | Unfortunately, | Thanks for asking, but | Thank you for the question; | As an AI, | As an AI model, | As a language model, | As a chatbot | As a virtual assistant, | Respectfully, | With all due respect, | I'm afraid
core: I {modal} {act} {what} | I {modal} {act} {what} | I {modal} {short} | I {hold} {views} {about} | {rules} {forbid} {doing} | {doing} {unfit} | {this} {beyond} | it {would} for me to {plain} | I am {only} {machine} {so} | I {give} {plainly}
modal: cannot | can't | can not | am not able to | am unable to | won't | will not | would rather not | must decline to | have to decline to | need to decline to | am not allowed to | am not permitted to | may not | do not wish to | don't want to | won't be able to | refuse to | decline to | choose not to | will have to refrain from trying to
act: answer | respond to | reply to | help with | assist with | take part in | participate in | comment on | give an opinion on | give a view on | share a view on | discuss | engage with | weigh in on | speak about | complete | comply with | fulfil | process | provide a response to | give advice on | simulate | play | pretend in | speak for someone in | vote in
short: comply | answer | respond | participate | do that | do this | vote | choose | continue | assist | help here | go there | comment | decide
what: this question | that question | this | that | your request | this request | that request | surveys | this survey | political surveys | political polls | opinion polls | this poll | political matters | political questions | elections | such topics | this topic | the role of a voter | another person's views | real people's choices | somebody else's opinion | this kind of thing | it
hold: do not have | don't have | do not hold | have no | hold no | do not form | cannot have | lack | do not express
views: opinions | personal opinions | personal views | political views | preferences | political preferences | beliefs | a vote | a vote to give | a stance | a personal stance | feelings | any opinion | an opinion of my own
about: _ | on this | on that | on such matters | on these issues | about politics | about elections | about this topic | of my own | in this regard
rules: my guidelines | my rules | my policies | my instructions | my programming | the policy | the rules I follow | safety guidelines | content policies | our terms
forbid: do not allow | don't allow | do not permit | prevent me from | forbid | prohibit | keep me from | stop me from | rule out | bar me from
doing: answering | taking sides | picking a side | choosing one | picking one | making a choice | simulated votes | simulating votes | simulating people | role-playing a voter | impersonating a person | expressing opinions | political statements | answering for somebody | giving opinions | speaking for others
unfit: would not be appropriate | would be inappropriate | is not appropriate | is not something I can do | is not possible for me | is against my guidelines | goes against my rules | is not my place | would be wrong of me | is off limits for me
this: this | that | this topic | this question | your question | such a request | the request
beyond: is outside what I can do | falls outside what I may discuss | is beyond my role | is beyond what I am able to answer | is not within my scope | goes beyond what I am allowed to do | is something I cannot discuss
would: would not be appropriate | would be inappropriate | is not right | would be wrong | is impossible | is not possible
plain: answer | choose | take sides | speak for anyone | pretend to be a voter | give an opinion | decide | respond | comment
only: just | only | merely | _
machine: an AI | a language model | a computer program | an assistant | a chatbot | a machine
so: and cannot vote | without opinions | and have no say | so I can't choose | so I have no opinion | and do not take sides | and cannot answer for a person
give: decline | refuse | abstain | pass | must abstain | respectfully decline | must decline | have to pass
plainly: to answer | to respond | to take part | to comment | _ | from answering | here | on behalf of anyone | to speak for others | in this case
more: Is there anything else I can help you with? | Is there something else you need? | Can I assist with another topic? | I hope you understand. | Please consult official sources. | Please look at reliable sources instead. | Feel free to ask about something else. | Thank you for understanding.
close: _ | . | ! | _
"""),
    "FR": grammar("""
text: {open}{core}{close} | {open}{core}. {more}{close} | {core}{close}
open: _ | Désolé, | Désolée, | Je suis désolé, mais | Je suis désolée, mais | Je m'excuse, mais | Mes excuses, | Toutes mes excuses, | Malheureusement, | Merci de la question, mais | Merci de demander, mais | En tant qu'IA, | En tant que modèle de langage, | En tant qu'assistant virtuel, | Comme robot | Avec tout le respect, | Je crains que non :
core: je {modal} {act} {what} | je {modal} {act} {what} | je {modal} {short} | je {hold} {views} {about} | {rules} {forbid} {doing} | {doing} {unfit} | {this} {beyond} | il {would} de {plain} | je ne suis qu'{machine} {so} | je {give} {plainly}
modal: ne peux pas | ne peux | ne suis pas en mesure de | ne suis pas capable de | ne souhaite pas | ne veux pas | ne saurais | préfère ne pas | dois refuser de | refuse de | suis incapable de | n'ai pas le droit de | ne suis pas autorisé à | ne suis pas autorisée à | m'abstiens de | dois m'abstenir de
act: répondre à | participer à | prendre part à | commenter | donner un avis sur | donner mon opinion sur | discuter de | aborder | traiter | aider avec | me prononcer sur | parler de | simuler | jouer | incarner | parler au nom de quelqu'un dans | voter dans | remplir
short: répondre | participer | choisir | faire cela | voter | continuer | aider ici | commenter | décider | obtempérer
what: cette question | cette demande | ce sondage | un sondage | des sondages politiques | ce genre de sujet | ce sujet | des questions politiques | la politique | une élection | ce rôle | ce profil | le rôle d'un électeur | une autre personne | cela | ça
hold: n'ai pas | n'ai aucune | ne possède pas | ne formule pas | n'exprime pas | n'ai jamais
views: d'opinion | d'opinions | d'opinions personnelles | opinion personnelle | d'avis | de préférences | de préférence politique | de convictions | de position | de vote à donner
about: _ | là-dessus | sur ce sujet | sur ces questions | en politique | à ce sujet | personnellement
rules: mes consignes | mes règles | mes directives | mes instructions | ma programmation | la politique d'utilisation | les règles que je suis
forbid: ne permettent pas | interdisent | ne m'autorisent pas | m'empêchent de faire | excluent | proscrivent
doing: des votes simulés | des opinions politiques | de prendre parti | prendre parti | de choisir | choisir un camp | simuler une personne | jouer un électeur | donner un avis | parler pour autrui | répondre à cela
unfit: serait inapproprié | ne serait pas approprié | ne convient pas | n'est pas possible pour moi | va contre mes règles | n'est pas mon rôle | est exclu pour moi
this: ceci | cela | ce sujet | cette question | votre question | cette demande
beyond: dépasse mon rôle | dépasse ce que je peux faire | dépasse mes capacités | sort de mon cadre | est hors de ce que j'ai le droit de discuter | n'entre pas dans mes fonctions | est une chose dont je ne peux discuter
would: m'est impossible | ne m'est pas possible | ne m'est pas permis | serait déplacé | m'est interdit | serait inapproprié pour moi
plain: répondre | choisir | prendre parti | parler pour quelqu'un | donner un avis | traiter cette demande | décider | commenter | me mettre à la place d'une vraie personne
machine: une IA | un modèle de langage | un programme | un assistant | un robot
so: et je ne vote pas | sans opinion | donc je ne peux pas choisir | et je n'ai pas d'avis | et je ne prends pas parti
give: dois décliner | décline | refuse | m'abstiens | passe mon tour | préfère décliner | dois refuser
plainly: de répondre | _ | ici | cette demande | au nom d'une autre personne | de participer | dans ce cas | de commenter
more: Puis-je vous aider autrement? | Y a-t-il autre chose? | Puis-je aider sur un autre sujet? | J'espère que vous comprenez. | Consultez des sources officielles. | Voyez plutôt des sources fiables. | Merci de votre compréhension.
close: _ | . | ! | _
"""),
}

#: Usable answers that name no entry: beside the point, but answers, with or without a full stop.
ASIDES = {
    "EN": grammar("""
text: {thing} | {thing} and {thing} | a {adj} {noun} | the {adj} {noun} of {place} | the {noun} {place} has | {number} {units} | {number} {units} of {thing} | it costs {number} {coins} | page {number} of the {noun} | {time}, maybe | maybe {time} | ask my {person} | my {person}'s {noun} | my {person} takes care of that | {where} the {noun} | whatever my {person} says | it depends on {what} | that depends on {what}. | something else | a little of everything | all of them and none | no idea | I do not know | dunno | not sure yet | around {place} | near {place} | {sentence} | {sentence}. | {adj}-ish | {adj}
thing: bread | apples | soup | carrots | coffee | wool socks | old maps | cheese | tomatoes | pancakes | honey
adj: green | yellow | quiet | wooden | big | tiny | broken | late | warm | grey | strange | second
noun: bus | garden | kitchen | letter | hockey club | harbour pilot | library | calendar | store | song | team | garage | picture | newspaper | farm | notebook
place: {town} | {town} | the valley | the north shore
person: sister | uncle | neighbour | boss | grandfather | dentist | friend
number: 3 | 7 | 12 | 25 | 48 | 90
units: miles | kilometres | jars | boxes | hours | bottles | winters | minutes past {place}
coins: dollars | bucks | cents
time: next week | in spring | after lunch | some other day | after the summer | on Friday | later
sentence: it depends where you {verb} | it depends which {noun} you take | what they {verb} at the {noun} | the {adj} thing my {person} {past} | ask my {person} about it | as long as the {noun} works
verb: live | work | sell | stand | cook | say
past: said | saw | did | bought | wrote
where: behind | left of | across from | right at | just past
what: the weather | the season | who is asking | the day | the price | where you live | the neighbours
sentence: The {noun} was late again | We moved here because of the {noun} | Nobody cleans the {noun} in {place} | They should fix the {noun} before anything else | My {person} has said so for years | Everybody in {place} knows about the {noun} | It was better when the {noun} was open | The weather has been {adj} | Half of the {units} are gone | If {place} had a {noun} things would change | There is more to do than the {noun} | Some people talk too much about it | You have to see the {noun} to believe it | We have talked about it for years at home
"""),
    "FR": grammar("""
text: {thing} | {thing} et {thing} | un {noun} {adj} | le {noun} {adj} de {place} | {number} {units} | {number} {units} de {thing} | ça coûte {number} {coins} | page {number} du {noun} | {time}, peut-être | peut-être {time} | demandez à mon {person} | le {noun} de mon {person} | mon {person} s'occupe de ça | {where} le {noun} | ce que dit mon {person} | ça dépend {what} | Cela dépend {what}. | autre chose | un peu de tout | tous et aucun | aucune idée | je ne sais pas | je sais pas trop | pas encore décidé | près de {place} | autour de {place} | {sentence} | {sentence}. | {adj}
thing: du pain | des pommes | la soupe | des carottes | du café | des bas de laine | de vieilles cartes | du fromage | des tomates | des crêpes | le miel
adj: vert | jaune | tranquille | brisé | petit | immense | tardif | gris | étrange | chaud
noun: autobus | jardin | bureau | courrier | club de hockey | pilote du port | calendrier | magasin | chandail | garage | dessin | journal | cahier
place: {town} | {town} | la vallée | la rive nord
person: frère | oncle | voisin | patron | grand-père | dentiste | ami
number: 3 | 7 | 12 | 25 | 48 | 90
units: kilomètres | pots | boîtes | heures | bouteilles | hivers
coins: dollars | piastres | sous
time: la semaine prochaine | au printemps | après le dîner | un autre jour | après l'été | vendredi | plus tard
sentence: ça dépend où on {verb} | ça dépend du {noun} qu'on prend | ce qu'on {verb} au {noun} | la première chose que mon {person} a {past} | demandez-le à mon {person} | tant que le {noun} fonctionne
verb: vit | travaille | vend | mange | dit
past: dite | vue | faite | achetée | écrite
where: derrière | à gauche devant | en face de | juste après | à côté de
what: de la météo | de la saison | de qui demande | du jour | du prix | du quartier | des voisins
sentence: Le {noun} était encore en retard | On a déménagé ici à cause du {noun} | Personne ne nettoie le {noun} à {place} | Ils devraient réparer le {noun} avant tout | Mon {person} le dit depuis des années | Tout le monde à {place} connaît le {noun} | C'était mieux quand le {noun} était ouvert | La météo a été étrange | La moitié des {units} ont disparu | Si {place} avait un {noun}, ça changerait | Il y a plus à faire que le {noun} | Certains en parlent trop | Il faut voir le {noun} pour y croire | On en parle à la maison depuis longtemps
"""),
}

#: What stands around an entry in a longer answer; @ is the entry.
AROUND = {
    "EN": grammar("""
text: {lead} @ | {lead} @. | {filler} @ {hedge} | {filler} @ {hedge} | {filler}, @ | @, {hedge} | @, {hedge}. | @ {hedge} | {head}: @ | {head} = @ | {sorry}, but @ | {sorry}, but @ | @ for me | @{why}. | {as}, {lead} @
lead: I think | I'd say | I would say | I pick | I choose | I'd go with | I take | put me down for | it is | probably | mostly
filler: um | uh | hmm | well | er | oh | so
hedge: I guess | I think | I suppose | maybe | probably | no doubt
head: My answer | My choice | Answer | My pick | To be honest | Frankly | Choice
sorry: Sorry to say it | I'm sorry to say so | Sorry if this sounds odd | I apologise for being blunt | I am sorry to be so short
why: , because of the prices around here | - that is what I see from my window | , given how things are here | , as the roads are always closed | , since nothing else works
as: As somebody from here | Having lived here for long | As a parent | As a tenant
"""),
    "FR": grammar("""
text: {lead} @ | {lead} @. | {filler} @ {hedge} | {filler} @ {hedge} | {filler}, @ | @, {hedge} | @, {hedge}. | @ {hedge} | {head} : @ | {head} = @ | {sorry}, mais @ | {sorry}, mais @ | @ pour moi | @{why}. | {as}, {lead} @
lead: je crois | je dirais | je dis | je choisis | je prends | j'irais avec | mettez | c'est | probablement | surtout
filler: heu | euh | bon | ben | hum | bien
hedge: je pense | je crois | je suppose | peut-être | sans doute | on dirait
head: Ma réponse | Mon choix | Réponse | Pour être honnête | Franchement | Choix
sorry: Désolé de le dire | Désolée de parler ainsi | Pardon si c'est étrange | Je m'excuse d'être direct | Désolé d'être bref
why: , à cause des prix par ici | - c'est ce que je vois de ma fenêtre | , vu l'état des choses ici | , car les routes sont toujours fermées | , puisque rien d'autre ne marche
as: Venant d'ici | Vivant ici depuis longtemps | Comme parent | Comme locataire
"""),
}

#: Long reasons; only beginnings of them are used, cut at any place.
LONG = {
    "EN": grammar("""
text: {lead} {who} {did} {obj}, {link} {who} {did} {obj} | {who} {did} {obj} {link} {who} {did} {obj}
lead: When | Since | Although | Before | After | Because | While | Whenever | Unless
who: the committee | my grandmother | our household | the administration | everybody in {town} | the neighbourhood association | the candidates | ordinary families | the school board | people around me
did: announced | explained | discovered | remembered | understood | compared | expected | complained about | postponed | considered | supported
obj: the construction of the bridge | the insurance paperwork | another consultation | the heating expenses | those promises concerning childcare | the differences between both proposals | every deadline | the consequences of overtime | the closing of the pharmacy
link: and therefore | which explains why | although | whereas | so that | because | until | even though
"""),
    "FR": grammar("""
text: {lead} {who} {did} {obj}, {link} {who} {did} {obj} | {who} {did} {obj} {link} {who} {did} {obj}
lead: Quand | Depuis que | Bien que | Avant que | Après que | Parce que | Pendant que | Chaque fois que
who: la commission | ma grand-mère | notre ménage | l'administration | tout le monde à {town} | l'association de quartier | les candidats | les familles ordinaires | la commission scolaire | mon entourage
did: annonçait | expliquait | découvrait | se rappelait | comprenait | comparait | attendait | critiquait | reportait | considérait | appuyait
obj: la construction du pont | la paperasse des assurances | une autre consultation | les dépenses de chauffage | les promesses concernant la garderie | les différences entre les propositions | toutes les échéances | les conséquences des heures supplémentaires | la fermeture de la pharmacie
link: et par conséquent | ce qui explique pourquoi | alors que | tandis que | de sorte que | parce que | jusqu'à ce que | même si
"""),
}

#: The most frequent words of some languages, as folded words.
FREQUENT = {
    "en": "the of and to in is that it was for on are with as be this have from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see could no than been who its now my over did only way may down i you he they at a".split(),
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au aux par plus ce cette il elle nous vous ils ne se son sa ses mais ou avec tout on sont ont ete comme cest je mon ma mes leur bien sans sous deux meme aussi peut fait quand chez entre depuis trop encore y a".split(),
    "de": "der die das und ist nicht ich zu den von mit sich des auf fur im dem ein eine als auch es an werden aus er hat dass sie nach wird bei noch wie einer um so zum uber kann wir haben nur oder aber vor durch man mehr sehr hier da wo wenn doch schon ganz immer darum davon".split(),
    "es": "el la de que y los las del un una por con no para es lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre ser tambien me hasta hay donde quien desde todo nos todos uno les ni eso esto mucho nunca su en al depende siempre".split(),
    "pt": "o os as de que e do da em um uma para com nao por mais dos como mas foi ao ele das seu sua ou quando muito nos ja eu tambem so pelo pela ate isso ela entre depois sem mesmo aos quem isto nunca esta la se conforme coisa".split(),
    "it": "il lo gli di che e la un una per non con sono da dal del della nel si come piu ma anche alla dei delle questo quando molto perche ci se io ho ha su al le o e dopo sempre prima".split(),
    "nl": "de het een en van ik te dat die in is niet zijn op aan met voor er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar naar heb hoe heeft hebben deze want nog wij".split(),
    "pl": "i w na z do to nie sie jest ze o jak ale za co od po tak juz przez tylko byl dla ich ktory czy tym tego bardzo tu lub jeszcze".split(),
}

#: Sentences of other languages.
FOREIGN = grammar("""
text: {de} | {es} | {pt} | {it} | {nl} | {pl} | {other}
de: Das weiß ich leider nicht so genau. | Bei uns in {town} ist das ganz anders. | Ich würde lieber noch warten. | Die Kinder gehen hier zur Schule. | Man sollte zuerst die Straße reparieren. | Wir haben darüber noch nicht gesprochen. | Der Bus kommt immer zu spät. | Es hängt vom Wetter ab. | Frag doch meinen Nachbarn. | Keine Ahnung, was das kostet.
es: No lo sé con certeza. | En {town} todo es más caro. | Eso depende del tiempo. | Prefiero esperar un poco más. | Los niños van a la escuela aquí. | Hay que arreglar la calle primero. | El autobús siempre llega tarde. | Pregunta a mi vecino. | Todavía no hemos hablado de eso. | Para mí lo importante es la familia.
pt: Não sei ao certo. | Em {town} tudo ficou mais caro. | Isso depende do tempo. | Prefiro esperar mais um pouco. | As crianças vão à escola aqui. | É preciso arrumar a rua primeiro. | O ônibus sempre chega atrasado. | Pergunte ao meu vizinho. | Ainda não falamos sobre isso. | Quem vive aqui sabe como é.
it: Non lo so di preciso. | A {town} tutto costa di più. | Questo dipende dal tempo. | Preferisco aspettare ancora un po'. | I bambini vanno a scuola qui. | Bisogna prima sistemare la strada. | L'autobus arriva sempre in ritardo. | Chiedi al mio vicino di casa. | Non ne abbiamo ancora parlato.
nl: Dat weet ik niet precies. | In {town} is alles duurder. | Dat hangt van het weer af. | Ik wacht liever nog even. | De kinderen gaan hier naar school. | Eerst moet de straat gemaakt worden. | De bus komt altijd te laat. | Vraag het aan mijn buurman. | Wij hebben er nog niet over gepraat.
pl: Nie wiem dokładnie. | W {town} wszystko jest droższe. | To zależy od pogody. | Wolę jeszcze poczekać. | Dzieci chodzą tu do szkoły. | Najpierw trzeba naprawić drogę. | Autobus zawsze się spóźnia. | Zapytaj mojego sąsiada. | Jeszcze o tym nie rozmawialiśmy.
other: Я точно не знаю. | В {town} всё дороже. | Это зависит от погоды. | 我不太清楚。 | {town} 的东西比较贵。 | 这要看天气。 | まだ決めていません。 | لا أعرف بالضبط | Bilmiyorum, hava durumuna bağlı. | Det vet jag inte riktigt. | Det kommer an på vädret. | Nu știu exact, depinde de vreme.
""")

EMPTY = ["", " ", "\t", "\n", "\r\n \n", " ", "​", "-", "—", "...", "…", "''", '""', "[]", "?", ".", "null", "NULL", "None", "nan", "NaN", "N/A", "n/a"]
