"""The small labelled table that the tagger of personal information is trained on.

A row is a sentence with its mentions marked ``[TYPE text]``. Sentences are given as patterns
whose slots are filled from invented parts, so that the tagger learns words around and shapes
of mentions, not particular names. Patterns without a slot of a type are negative examples.
"""

from __future__ import annotations

import random
import re

GIVEN = "Nora Olga Ilan Vera Wim Cleo Ada Otis Ursula Zita Milo Iris Abel Yara Enzo Lars Dora Ezra Gwen Anton Rosa Theo Mina Leon Signe Timo Vito Alma Aron Edda Yann Maja Ruth Igor Ondine Cyril Odette Basile Wilma Orson Isolde Anna Paul Léa Marc Sofia Jean Claire Omar Ines Hugo Marie Peter Nadia Louis Emma Karim Julie David Sarah Ahmed Chloé Thomas Élise Viktor Noémie Ivan Helena Bruno Fatima Oscar Zoé Martin Irène Felix Maya Simon Aïcha Robert Lucie Henrik".split()
ONSET = "B Br C Cl D Dr F Fl G Gr H J K L M Mar N P Pr Qu R S St T Tr V W Z Ch Sch".split()
MIDDLE = "a e i o u au el er ir or un an en al om ar".split()
END = "bert beck ton ville mont lin gard ner sen ridge feld court nier quet ham stone dell mark thal vane roy let din son berg mann ski lier sart by rick".split()
CITY_END = "dale mouth furt haven bourg ville ford port wick vane merle gny nau brèche mere quay".split()
STREETS_EN = "Road Lane Street Close Court Yard Bend Avenue Drive Way Terrace Crescent Hill Square Row Walk Gardens Grove Place Mews".split()
STREETS_FR = ["rue", "avenue", "boulevard", "impasse", "allée", "chemin", "quai", "place", "cours", "route", "passage", "square", "sentier", "rue", "rue"]
FR_TAILS = ["des Tilleuls", "de la Gare", "du Moulin", "de l'Église", "aux Herbes", "Victor Dubosc", "des Chênes", "du Port", "de la Fontaine", "Sainte-Odile", "Grandval", "du Pré-Long", "de l'Arsenal", "des Remparts", "Bellecombe", "de Verdun", "du Vieux-Pont", "aux Fleurs"]
ES = ["calle", "Calle", "plaza", "avenida", "Avenida"]
ES_TAILS = ["del Sol", "de los Pinos", "Mayor", "Nueva", "Nueva del Mar", "de la Cruz", "del Río", "de las Flores", "Real", "Alta del Puente"]
DE = ["gasse", "weg", "straße", "allee", "kamp", "platz", "ufer", "damm", "strasse"]
FIRM_TAIL = ["Ltd", "SARL", "SA", "SAS", "GmbH", "BV", "LLP", "Inc.", "plc", "AG"]
FIRM_MID = ["Works", "Holding", "Services", "Matériaux", "Énergie", "Partners", "Logistics", "Conseil", "Systems", "Industries", "Freight", "& Fils", "Group", "Transport", "Construction", "Trading", "Capital", "Solutions"]
MAIL_HOSTS = ["example.com", "example.net", "example.org", "mail.sample.example", "office.firma.example", "kontor.test", "bureau.invalid", "post.north-hub.example", "depot.invalid", "atelier.test"]
EN_ADJ = "annual monthly final joint disputed sealed certified regional secondary unpaid nominal inland standard renewable measured pending archived default first-class long-term missing recurring customary overdue".split()
EN_NOUN = "invoice contract pump valve delivery ceiling warranty audit permit shipment tolerance breach premium schedule ledger pallet survey clause statement receipt conveyor generator compressor baseline tender deposit gasket register appendix notice dispute cable freight terminal licence".split()
EN_VERB = "records limits confirms amends suspends extends excludes replaces validates settles describes reduces covers supports triggers references mentions governs cancels documents precedes".split()
OTHER = "mandatory revised binding floating technical partial amended statutory corrected approved general special technical total internal external draft sample quarterly marginal adjusted combined residual temporary complete separate shared written customs damaged deferred rejected".split()
JOINS = ["Conversely", "Accordingly", "Furthermore", "Moreover", "However", "Meanwhile", "Nevertheless", "Similarly", "In practice", "To date", "By exception", "As agreed", "As recorded", "Upon review", "For clarity", "In addition", "Toutefois", "Dès lors", "À défaut", "De même", "En outre", "En pratique", "Par exception", "Le cas échéant", "Pour mémoire", "À ce jour", "En revanche", "Consequently", "Finally", "Cependant"]
FR_ADJ = "annuel mensuel définitif contesté scellé certifié régional secondaire échu provisoire contractuel révisé vérifié conforme partiel différé technique courante litigieuse déclarée".split()
FR_NOUN = "contrat paiement filtre règlement câble retard devis bordereau plafond transport facture pompe vanne garantie livraison créance mesure turbine palette réserve commande rapport solde avenant".split()
FR_VERB = "constate limite confirme modifie suspend prolonge exclut remplace valide décrit réduit couvre déclenche mentionne annule précède rappelle absorbe reporte restreint solde garantit".split()
MONTHS = "January February March April May June July August September October November December janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()

#: Patterns with mentions. Slots: N name, A address, E e-mail, P phone, I identity number; U unit of a building, F firm, C place, D date, R reference, O order or lot number, S a plain clause.
WITH = [
    "Contact: {N}, tel. {P}, {E}.", "Contact : {N}, tél. {P}, {E}.", "Contact: {N} / tel. {P} / {E}", "Contact: {N} ; {E} ; {P}", "Contact person: {N} ({P}).",
    "Please call {P} before {D} and quote {R}; ask for {N}.", "Call {P} before {D} and quote {R}; ask for {N}.", "Phone {P} or write to {E}.", "Tel: {P}", "Tél. : {P}", "Fax {P}, {E}", "Mobile: {P}.", "You can reach {N} on {P} from {D}.", "Appelez le {P} avant le {D}.", "Joindre {N} au {P}.",
    "Invoices are posted to {U}{A} and copied to {E}.", "Invoices are sent to {A} and copied to {E}.", "Notices go to {N}, {U}{A}, or by mail to {E}.", "Notices go to {N}, {A}, or by mail to {E}.", "Deliver to {N}, {U}{A}; phone ahead on {P}.",
    "Livrer chez {N}, {U}{A} ; prévenir au {P}.", "Livrer chez {N}, {A} ; prévenir au {P}.", "Toute notification est envoyée à {U}{A}.", "Toute notification est envoyée au {U}{A}.", "Toute notification est envoyée au {A}.", "Adresse : {U}{A}.", "Address: {U}{A}", "Our new office is at {A}.", "Il habite {A}.",
    "Réclamation adressée à {E} puis par téléphone au {P} le {D}.", "Claim sent to {E} then by telephone to {P} on {D}.", "Écrire à {E}.", "Write to {E} or {E}.", "E-mail {E}", "mail: {E}; {P}", "<{E}>", "mailto:{E}", "copied to <{E}>.", "copied to mailto:{E}.",
    "Le soussigné {N}, demeurant {U}{A}, {I}, atteste la réception du lot {R}.", "Le soussigné {N}, demeurant {A}, {I}, atteste la réception du lot {R}.", "La soussignée {N}, née le {D}, demeurant {A}.", "The undersigned {N}, residing at {A}, {I}, confirms receipt of {R}.",
    "Titulaire : {N} ({I}).", "Titulaire : {N} ({I}). Dossier {R}, {F}.", "Holder: {N} ({I}).", "{N} ({I}) signed on behalf of {F}.", "{N} ({I}) a signé pour {F}.", "Driver identified as {N}, {I}, at {C}.", "Conducteur identifié : {N}, {I}, à {C}.",
    "{N} signed on behalf of {F}.", "Signé par {N} pour {F}, à {C}.", "Signed by {N} for {F}, at {C}.", "{N} a refusé de contresigner le bordereau {R} de {F}.", "{N} refused to countersign {R} of {F}.", "According to {N}, the {s} was never returned to {F}.", "Selon {N}, le {t} n'a jamais été rendu à {F}.", "The goods were received by {N} at the {C} dock under {R}.", "Les marchandises ont été reçues par {N} au quai de {C}.", "Witness: {N}", "Attention: {N}, {F}", "À l'attention de {N}, {F}", "Dear {N},", "Cher {N},", "Regards, {N}", "approved by {N} on {D}", "Mme et M. sont absents ; voir {N}.",
    '{"contact": "{N}", "phone": "{P}", "lot": "{O}"}', '{"name": "{N}", "email": "{E}"}', "| {N} | {P} | {E} | {R} |", "| {N} | {P} | {R} |", "{N} | {P} | {E}", "{N};{E};{P}", "{N}\n{A}\n{P}", "{N}, {A}", "ID: {I}, {N}", "{I}", "Passenger {N} with {I} boarded at {C}.", "Bénéficiaire {N}, {I}.",
    "{T} {N} signed on behalf of {F}.", "{T} {N}", "Contact: {T} {N}, tel. {P}.", "ask for {T} {N}.", "Le soussigné {T} {N}, demeurant {A}, {I}.", "Livrer chez {T} {N}, {U}{A} ; prévenir au {P}.", "Livrer chez {T} {N}, {A} ; prévenir au {P}.", "Notices go to {T} {N}, {A}, or by mail to {E}.", "Driver identified as {T} {N}, {I}, at {C}.", "{S} {N} signed on behalf of {F}. {S}", "{S}\n\nLivrer chez {N}, {U}{A} ; prévenir au {P}.\n\n{S}", "{S}\n\nSigné par {N} pour {F}, à {C}.\n\n{S}", "{S} Toute notification est envoyée à {A}. {S}", "Signé par {T} {N} pour {F}, à {C}.", "According to {T} {N}, the {s} was never returned to {F}.", "received by {T} {N} at the {C} dock", "{T} {N} a refusé de contresigner le bordereau {R}.", "| {T} {N} | {P} | {E} |", '{"contact": "{T} {N}", "phone": "{P}"}', "{S} {T} {N} ({I}) signed on behalf of {F}.", "{S} Contact: {N} / tel. {P} / {E} {S}", "{S} Invoices are posted to {U}{A} and copied to {E}. {S}", "{S}\n\n{N} a refusé de contresigner le bordereau {R} de {F}.\n\n{S}", "{S} Call {P} before {D} and quote {R}; ask for {N}. {S}", "{S} According to {N}, the {s} was never returned to {F}.", "{S} The goods were received by {N} at the {C} dock under {R}. {S}",
]
#: Patterns without mentions.
WITHOUT = [
    "{S}", "{S} {S}", "{S}\n{S}", "{S}\n\n{S} {S}", "{F} {v} each {s} at {C} before {D}.", "{F} replaced {F} on {D}.", "{L} & Fils {f} replaced {F} on {D}.", "{F} {w} chaque {t} à {C} sous 14 jours.", "{F} {v} the {s} within 120 days of any {s} and {v} the {s}.", "Order {O} covers 52 units @ 29.50 each.", "Commande {O} : 12 unités à 4,50 €.", "Lot {O}, standard XN 63059:2016, firmware 13.4.52.3.", "Drawing XQ473-8823, sheet 15 of 20, {C} Quay.", "Plan {O}, feuille 3 sur 12.", "Posting key @dock_7 and batch {B} remain open.", "Batch {B} closed on {D}.", "# {S}", "# Damaged permit {R}", "{S} {R}", "Notice {R}   3", "Page 4 of 12", "p. 7", "{C}, le {D}", "Total: 65809 EUR | {D} | {R}", "Unit price: 6800 [unit: US dollars]", "The measured value (declared value) is 51 940 kilograms.", "Sheet {R} states a rated figure of 108.2677 feet.", "<table><tr><td>{s}</td><td>8005</td></tr><tr><td>{R}</td><td>70</td></tr></table>", "| {R} | {s} | 1204 | {D} |", "Marché n° 2024/90/558/437, article 3 bis.", "Art. 25 – garantie provisoire ({O})", "Receipt {O}: 645 pieces, cross-border {s}", "Reçu n° {O} : 399 pièces, solde conforme", "{F} - {s}, café annex {O}", "Sign-off sheet {O} of {D}, {s}", "Procès-verbal {O} du {D}, {t}", "Licence no. {O}, floor area 291 m²", "Under clause 13.8, the {s} {v} {s} {R}.", "Selon l'article 4.11, le {t} {w} le {t} sous la référence {R}.", "At {C}, every {s} {v} that {s}.", "À {C}, chaque {t} {w} tout {t} avant le {D}.", "Any {s} must be returned to {F} under clause 3.2.", "See annex. Signature", "N° TVA FR 12 345678901", "IBAN FR76 3000 6000 0112 3456 7890 189", "Invoice no. 2024-118-5531 of {D}", "Facture n° 118/5531 du {D}", "Version 2.14.3, build 20240118", "$$ P = 17 \\times \\frac{d}{195} $$", "{X}", "{Y}", "{H}", "Ref. {R}; {R}; {O}", "Gate 12, bay 4, dock 7", "{S} {F} {v} that {s}. {S}", "To date, {F} {v} the {s}; every {s} {v} the {s}.", "En outre, {F} {w} le {t} ; toute {t} {w} le {t}.", "The {s} and the {s} shall not exceed {k} units pending any {s}.", "Le {t} et tout {t} ne peuvent excéder {k} unités sous 30 jours.", "{Y} {S}",
]


#: The same of everyday writing, which shares no sentence with business papers: so that words around a mention are of many kinds.
EVERYDAY = [
    "Best wishes,\n{N}", "Kind regards\n{N}\n{P}", "Yours sincerely, {N}", "Cordialement,\n{N}", "Bien à vous, {N}", "Signed: {N}", "Signature : {N}", "Name: {N}", "Nom : {N}", "Full name: {N}", "Nom et prénom : {N}", "Client: {N}", "Tenant: {N}, {A}", "Our manager {N} will visit {C} on {D}.", "{N} joined the firm in 2019.", "{N} has been appointed director of {F}.", "{N}, director of {F}, said so on {D}.", "We met {N} and {N} in {C}.", "Nous avons rencontré {N} et {N} à {C}.", "Le rapport de {N} date du {D}.", "{N} travaille chez {F} depuis le {D}.", "the witness {N} stated that it was late", "the driver {N} left at noon", "le chauffeur {N} est parti", "the tenant, {N}, pays on {D}", "Prepared by: {N}", "Préparé par {N} le {D}", "cc: {N}; {N}", "To: {N} <{E}>", "From: {N} <{E}>", "De : {N} <{E}>", "I spoke with {N} yesterday.", "J'ai parlé à {N} hier.", "{N} wrote: the {s} is late.", "{N} : le {t} est en retard.", "Thanks to {N} for the {s}.", "Merci à {N} pour le {t}.", "our colleague {N} replied on {D}", "notre collègue {N} a répondu", "as {N} explained", "comme {N} l'a expliqué", "{N} and {N} agreed on {D}.", "Present: {N}, {N}, {N}", "Présents : {N}, {N}", "Author: {N}", "Reviewer {N}, {F}", "{N} did not attend.", "{N} n'est pas venu.", "{N} asked {F} for the {s}.", "{F} thanked {N} for it.", "on behalf of {F}, {N}", "pour {F}, {N}", "handed to {N} at {C}", "remis à {N} à {C}", "{N} accepted the {s} of {F}.", "{N} a accepté le {t} de {F}.", "signed by {N}", "signé par {N}",
    "His number is {P}.", "Her telephone number is {P}", "Son numéro est le {P}.", "telephone {P}", "téléphone : {P}", "Ring {P} after six.", "SMS to {P}", "Hotline {P} (24 h)", "Emergency number: {P}", "numéro d'urgence : {P}", "P: {P} | E: {E}", "T {P} F {P}", "fax number {P}", "Cell {P}", "Portable : {P}", "call me on {P}", "rappelez-moi au {P}", "{P} or {P}", "{P} / {P}", "reach us at {P}, Monday to Friday", "{N}: {P}", "{N} - {P}", "{N}, {P}, {E}", "Reception: {P}; stores: {P}", "Accueil {P}", "the caller used {P}", "dial {P} for help", "composez le {P}", "{S} {P}", "our fax is {P}", "voir {E} ou {P}", "between nine and five on {P}", "aux heures ouvrables : {P}",
    "{E}", "Reply to {E} by {D}.", "Répondre à {E} avant le {D}.", "my address is {E}", "send the {s} to {E}", "{N} lives at {A}.", "{N} habite au {A}.", "Registered office: {A}", "Siège social : {A}", "The house at {A} was sold on {D}.", "Rendez-vous au {A}.", "ship to {A}", "{A}", "moved from {A} to {A}", "His {I} expires on {D}.", "Document checked: {I}", "Pièce présentée : {I}", "she showed {I}", "{I}, issued at {C}", "{I}, délivrée à {C}", "born on {D}, {I}", "{N}, {I}, {A}",
]
#: Everyday writing without mentions.
EVERYDAY_WITHOUT = ["Kind regards,\n{F}", "Cordialement,\n{F}", "The board of {F} met in {C}.", "{F} has an office in {C}.", "We met in {C} on {D}.", "Name: {s}", "Client: {F}", "From: {F}", "Present: the buyers, the sellers", "Serial number {O}", "Account 00123 4567 8900", "the {s} of {F} and the {s} of {F}", "signed by both parties at {C}", "signé par les deux parties à {C}", "handed to {F}", "remis à {F} le {D}", "call number {R}", "numéro {O}", "number {O}, sheet 4", "ask for the {s}", "according to {F}", "selon {F}", "Author: {F}", "Batch {B}, {O}", "between {q} and {q}", "total {q}, of which {q}", "{h} of {C}", "{h}, {D}", "Dear customer,", "Madame, Monsieur,"]


def _place(r: random.Random) -> str:
    return r.choice(ONSET) + r.choice(MIDDLE) + r.choice(CITY_END) if r.random() < 0.8 else f"{r.choice(['Saint', 'Mont', 'Val'])}-{r.choice(ONSET)}{r.choice(MIDDLE)}{r.choice(CITY_END)}"


def _surname(r: random.Random) -> str:
    name = r.choice(ONSET) + r.choice(MIDDLE) + r.choice(["", r.choice("lrnmst") + r.choice(MIDDLE)]) + r.choice(END)
    return name if r.random() < 0.88 else f"{name}-{_surname(r)}"


def _given(r: random.Random) -> str:
    return r.choice(GIVEN) if r.random() < 0.5 else (r.choice(ONSET) + r.choice(MIDDLE) + r.choice(["l", "n", "s", "r", "lle", "na", "mi", "t", "ra", "li"]) + r.choice(["", "a", "e", "o", "ie", "ine"]))


def _name(r: random.Random, titled: bool = False) -> str:
    g, s = _given(r), _surname(r)
    if titled and r.random() < 0.5:
        return s
    return r.choice([f"{g} {s}"] * 6 + [f"{s.upper()} {g}", f"{s.upper()} {g}", f"{s}, {g}", f"{s}, {g}", f"{g[0]}. {s}", f"{g[0]}. {s}", f"{g} {r.choice('ABCDEFGHLMNPRST')}. {s}", f"{g} {r.choice('ABCDEFGHLMNPRST')}. {s}", f"{g[0]}. {r.choice('ABCDEFGH')}. {s}", f"{g} {s.upper()}"])


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _quantity(r: random.Random) -> str:
    big = r.choice([str(r.randint(1, 999)), f"{r.randint(1, 999)} {_digits(r, 3)}", f"{r.randint(1, 99)} {_digits(r, 3)} {_digits(r, 3)}", f"{r.randint(1, 999)}.{_digits(r, 3)}.{_digits(r, 3)}", f"{r.randint(1, 99)},{_digits(r, 3)},{_digits(r, 3)}", f"{r.randint(1, 99)}'{_digits(r, 3)}'{_digits(r, 3)}", _digits(r, 7).lstrip("0") or "7", f"{r.randint(1, 99)} {_digits(r, 3)} {_digits(r, 3)},{_digits(r, 2)}", f"{_digits(r, 1)}.{_digits(r, 3)}e{_digits(r, 1)}", f"{r.randint(1, 999)}.{_digits(r, 2)}"])
    return r.choice([f"{big} {r.choice(['EUR', 'euros', '€', 'USD', 'MAD', 'dirhams', 'kg', 'm', 'mm', 'kWh', 'litres', 'US cents', 'days', 'heures', 'L', 'ft²', 'unités', 'g', 'MJ', 'psi'])}", f"{r.choice(['EUR', 'USD', 'MAD', '$', '€', 'US$'])} {big}", big])


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    p = r.choice([f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}", f"0033(0){d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+44 (0){d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)}-{d(6)}", f"0{d(4)} {d(6)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"+33{d(9)}", f"+212 {d(3)}-{d(6)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)}\n{d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)}\n{d(2)} {d(2)}"])
    return p + r.choice(["", "", "", "", f" ext. {d(2)}", f" x{d(1)}"]) if p[0] not in "0" else p


def _email(r: random.Random) -> str:
    g, s = _given(r).lower(), _surname(r).lower().split("-")[0]
    local = r.choice([f"{g}.{s}", f"{g}-{s}", f"{s}_{g}", f"{g[0]}{s}", f"{s}{_digits(r, 2)}", f"{g}+lot{_digits(r, 1)}", f"{g}.{s}", f"info{_digits(r, 1)}"])
    host = r.choice(MAIL_HOSTS)
    kind = r.random()
    if kind < 0.12:
        return f"{local} [at] {host.replace('.', ' [dot] ')}"
    if kind < 0.17:
        return f"{local} [at] {host.replace('.', r.choice([' [dot] ', chr(10) + '[dot] ', ' [dot]' + chr(10)]))}"
    if kind < 0.28:
        return f"{local}(at){host}"
    if kind < 0.32:
        return f"{local} at {host.replace('.', ' dot ')}"
    mail = f"{local}@{host}"
    return mail.upper() if kind < 0.42 else mail


def _address(r: random.Random) -> str:
    no = str(r.randint(1, 220)) + r.choice(["", "", "", "A", "b", " bis", " ter"])
    kind = r.random()
    if kind < 0.35:
        road = f"{no.split()[0]} {r.choice([_surname(r).split('-')[0], _surname(r).split('-')[0], 'Old ' + r.choice(['Mill', 'Church', 'Ferry', 'Bridge']), 'Lower ' + r.choice(['Mill', 'Park']), 'North ' + r.choice(['Dock', 'Gate'])])} {r.choice(STREETS_EN)}"
    elif kind < 0.72:
        road = f"{no}{r.choice([',', '', ''])} {r.choice(STREETS_FR)} {r.choice(FR_TAILS)}"
    elif kind < 0.77:
        road = f"{r.choice(['Am', 'An der', 'Zum', 'Zur', 'Auf dem', 'Im'])} {r.choice(['Alten ', 'Neuen ', 'Hohen ', ''])}{r.choice(['Markt', 'Bahnhof', 'Hafen', 'Tor', 'Graben', 'Anger', 'Weiher', 'Steg', 'Feld'])} {r.randint(1, 99)}"
    elif kind < 0.87:
        road = f"{r.choice(ONSET)}{r.choice(MIDDLE)}{r.choice(['n', 'l', 'r', 'hlen', 'rft', 'nden', 'rch'])}{r.choice(DE)} {r.randint(1, 99)}"
    else:
        road = f"{r.choice(ES)} {r.choice(ES_TAILS)}, {r.randint(1, 99)}"
    city = _place(r)
    tail = r.choice([f", {r.randint(10000, 99999)} {city}", f" - {r.randint(10000, 99999)} {city}", f", {city}", f", {city} {r.choice('QZXV')}{r.choice('QXV')}{r.randint(1, 19)} {r.randint(1, 9)}{r.choice('QZX')}{r.choice('XZ')}", f", {city}, {r.randint(0, 99999):05d}", f", {r.randint(10000, 99999)} {city}", ""])
    return (road + tail).replace(", ", ",\n", 1) if r.random() < 0.04 else road + tail


ID_WORDS = ["passport {0}", "passport no. {0}", "passeport n° {0}", "holder of passport no. {0}", "passeport {0}"], ["SSN {1}", "SSN: {1}", "n° SS : {1}", "social security no. {1}", "social security number {1}"], ["TIN {2}", "taxpayer no. {2}", "taxpayer number {2}", "numéro fiscal {2}"], ["NI number {3}", "national insurance {3}", "national insurance no. {3}", "NINO {3}"], ["NIR {4}", "n° SS : {4}", "assuré social n° {4}", "N° sécurité sociale {4}", "sécurité sociale : {4}", "NIR : {4}"], ["CNI {5}", "ID card {5}", "carte d'identité n° {5}", "identity card no. {5}", "carte nationale d'identité {5}"]


def _identity(r: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(r, n)
    cap = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTWXYZ") for _ in range(n))
    k = r.randrange(6)
    number = [f"{cap(2)}{d(7)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{cap(2)} {d(2)} {d(2)} {d(2)} {cap(1)}" if r.random() < 0.7 else f"{cap(2)}{d(6)}{cap(1)}", r.choice([f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('12')}{d(14)}"]), f"{cap(1)}-{d(4)}-{d(3)}-{cap(1)}" if r.random() < 0.7 else d(12)][k]
    if r.random() < 0.06:
        number = number.replace(" ", "\n", 1)
    return r.choice(ID_WORDS[k]).format(*[""] * k, "\0", *[""] * 5), number


def _fill(pattern: str, r: random.Random) -> str:
    def firm() -> str:
        return f"{_surname(r).split('-')[0]} {r.choice(FIRM_MID)} {r.choice(FIRM_TAIL)}" if r.random() < 0.85 else f"{_surname(r).split('-')[0]} {r.choice(FIRM_TAIL)}"

    def ref() -> str:
        cap = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTWXYZ23456789") for _ in range(n))
        return r.choice([f"REF-{cap(r.randint(5, 7))}", f"DOC-{_digits(r, 5)}-{cap(1)}", f"REV_{_digits(r, 3)}{r.choice('ABCDE')}", f"ID{cap(r.randint(4, 7))}", f"{r.choice('KLMNPQ')}{_digits(r, 3)}/{_digits(r, 4)}"])

    def date() -> str:
        return r.choice([f"{r.randint(1, 28)} {r.choice(MONTHS)} {r.randint(2018, 2028)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(2018, 2028)}", f"{r.randint(2018, 2028)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"])

    def order() -> str:
        return r.choice([f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 5)}", f"0{_digits(r, 3)}-{_digits(r, 4)}-{_digits(r, 2)}", f"{r.choice('NPQRST')}{_digits(r, 7)}{r.choice('ABC')}-{_digits(r, 3)}-{_digits(r, 2)}", f"{r.choice('XZ')}{r.choice('QZ')}{_digits(r, 3)}-{_digits(r, 4)}", _digits(r, 5), f"{r.choice('ABCD')}{_digits(r, 2)}-{_digits(r, 8)}"])

    def clause() -> str:
        if r.random() < 0.55:
            a, n, v = (lambda: r.choice(EN_ADJ)), (lambda: r.choice(EN_NOUN)), (lambda: r.choice(EN_VERB))
            det = lambda: r.choice("the that each every any such this".split())
            text = r.choice([f"{det()} {a()} {n()} {v()} {det()} {a()} {n()} at {_place(r)}", f"{det()} {a()} {n()} dated {date()} {v()} {det()} {n()} because {det()} {a()} {n()} {v()} {n()} {ref()}", f"In addition, {firm()} {v()} {det()} {a()} {n()} under clause {r.randint(1, 40)}.{r.randint(1, 20)}", f"within {r.randint(2, 180)} days of {det()} {n()}, {det()} {a()} {n()} {v()} {a()} {n()}", f"{det()} {n()} and {det()} {a()} {n()} shall not exceed {r.randint(100, 9999)} units before {date()}"])
        else:
            n, v = (lambda: r.choice(FR_NOUN)), (lambda: r.choice(FR_VERB))
            det = lambda: r.choice("le la tout toute chaque".split())
            a = lambda: r.choice(FR_ADJ)
            text = r.choice([f"{det()} {n()} {a()} {v()} {det()} {n()} {a()} à {_place(r)}", f"{det()} {n()} {a()} du {date()} {v()} {det()} {n()} sous la référence {ref()}", f"En outre, {firm()} {v()} {det()} {n()} {a()} selon l'article {r.randint(1, 40)}.{r.randint(1, 20)}", f"{det()} {n()} et {det()} {n()} {a()} ne peuvent excéder {r.randint(100, 9999)} unités sous {r.randint(2, 180)} jours"])
        lead = r.random()
        if lead < 0.35:
            text = f"{r.choice(JOINS)}, {text}"
        elif lead < 0.5:
            text = f"{r.choice(['At', 'À', 'At', 'Near'])} {_place(r)}, {text}"
        elif lead < 0.6:
            text = f"{r.choice(['before', 'avant le', 'until', 'dès le'])} {date()}, {text}"
        text = text[0].upper() + text[1:] + "."
        kind = r.random()
        return text.title() if kind < 0.08 else text.upper() if kind < 0.12 else text.replace(" ", "\n", 1) if kind < 0.2 else text

    def slot(m: re.Match) -> str:
        s = m[1]
        if s == "N":
            return f"[NAME {_name(r, m.start() > 3 and pattern[m.start() - 4 : m.start()] == '{T} ')}]"
        if s == "I":
            words, number = _identity(r)
            return words.replace("\0", f"[ID_NUMBER {number}]")
        made = {"A": lambda: f"[ADDRESS {_address(r)}]", "E": lambda: f"[EMAIL {_email(r)}]", "P": lambda: f"[PHONE {_phone(r)}]", "U": lambda: r.choice(["", "", f"Flat {r.randint(1, 40)}, ", f"Unit {r.randint(1, 40)}, ", f"Appt {r.randint(1, 40)}, ", f"Bât. {r.choice('ABCD')}, ", f"Apt {r.randint(1, 40)}, ", f"Résidence {_surname(r).split('-')[0]}, ", f"Bâtiment {r.choice('ABCD')}, "]), "F": firm, "C": lambda: _place(r), "D": date, "R": ref, "O": order, "S": clause, "T": lambda: r.choice(["Mr", "Mrs", "Ms", "Dr", "Dr.", "Mr.", "Mrs.", "Mme", "M.", "Mlle", "Me", "Prof."]), "L": lambda: _surname(r).split("-")[0], "f": lambda: r.choice(FIRM_TAIL), "B": lambda: _digits(r, 10), "s": lambda: f"{r.choice(EN_ADJ)} {r.choice(EN_NOUN)}", "t": lambda: f"{r.choice(FR_NOUN)} {r.choice(FR_ADJ)}", "v": lambda: r.choice(EN_VERB), "w": lambda: r.choice(FR_VERB), "k": lambda: str(r.randint(100, 9999)), "q": lambda: _quantity(r), "h": lambda: r.choice([f"{r.choice(EN_ADJ).title()} {r.choice(EN_NOUN).title()}", f"{r.choice(FR_NOUN).title()} {r.choice(FR_ADJ).title()}", f"{r.choice(OTHER).title()} {r.choice(EN_NOUN).title()}"]), "j": lambda: r.choice(JOINS), "X": lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789+/") for _ in range(80)), "Y": lambda: r.choice([f"Lot\n{r.randint(1, 90)}\nItem\n{r.randint(1, 30)}", f"{r.choice(EN_ADJ).title()} {r.choice(EN_NOUN).title()} | {date()}", f"- {r.choice(EN_NOUN)}: {r.randint(1, 900)}", f"{firm()}\n{r.choice(EN_NOUN).title()} {ref()}   {r.randint(1, 9)}"]), "H": lambda: f"## {r.randint(1, 60)}. {r.choice(['Objet', 'Scope', 'Definitions', 'Durée', 'Liability', 'Paiement', 'Term'])}"}
        return made[s]() if s in made else m[0]

    return re.sub(r"\{([A-Za-z])\}(?!\})", slot, pattern)


def rows(copies: int = 14, seed: int = 7, part: tuple[int, int] | None = None) -> list[str]:
    """The labelled sentences: every pattern ``copies`` times with other parts; with ``part`` (k, n) only every n-th pattern from k on."""
    r = random.Random(seed)
    patterns = WITH + WITHOUT + EVERYDAY + EVERYDAY_WITHOUT
    # neighbours in the list are alike, so they go to one part
    some = [p for i, p in enumerate(patterns) if part is None or (i // 4) % part[1] == part[0]]
    out = [_fill(p, r) for _ in range(copies) for p in some]
    r.shuffle(out)
    return out
