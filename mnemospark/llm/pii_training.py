"""Labelled sentences for the detector of personal information: templates of everyday writing, filled by chance.

Items are marked in the text as it is made, so their labels know nothing of the
candidates or features. A template has a group; models are fitted on some groups and
held out on others, so that wording that wasn't seen is what is measured.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given and family names of several languages.
GIVEN = (
    "James Mary John Linda Robert Susan Michael Karen David Nancy William Lisa Thomas Emily Daniel Laura Peter Hannah George Alice Oliver Grace Henry Sofia Lucas Emma "
    "Moritz Lena Stefan Katrin Jürgen Ute Pierre Camille Étienne Chloé Luca Giulia Marco Chiara Carlos Lucía Javier Inés João Beatriz Tiago Anna Piotr Kasia Jakub Zofia "
    "Ivan Olga Dmitri Svetlana Ahmed Fatima Omar Leila Yusuf Aisha Kavita Arjun Ananya Rahul Wei Mei Hiroshi Yuki Kenji Sakura Minh Linh Kofi Ama Chidi Ngozi Lars Ingrid Sven Astrid"
).split()
FAMILY = (
    "Smith Johnson Brown Miller Davis Wilson Moore Taylor Anderson Clark Lewis Walker Young King Wright Scott Hill Baker Nelson Carter Vogel Schneider Fischer Weber Hoffmann Krüger "
    "Dupont Moreau Lefèvre Girard Rossi Ferrari Bianchi García Fernández Álvarez Silva Ferreira Oliveira Wójcik Nowak Zieliński Ivanov Petrova Sokolov Hassan Khan Rahman Haddad "
    "Sharma Patel Menon Iyer Chen Wang Zhang Tanaka Suzuki Nakamura Nguyen Pham Mensah Okafor Eze Larsen Johansson Nilsen O'Brien McCarthy Murphy"
).split()
TOWNS = "London Paris Berlin Madrid Austin Boston Denver Portland Leeds Bristol Lyon Lille Bremen Dresden Sevilla Valencia Porto Vienna Zurich Dublin Cork Oslo Utrecht Ghent Springfield Riverside Oakland".split()
WORDS = (
    "report meeting invoice budget contract server kitchen garden lesson recipe draft printer window bicycle ticket order parcel delivery update schedule form account laptop password "
    "release backup battery lamp table chapter sample survey review summary photo letter folder engine filter sensor cable river train hotel visit doctor teacher manager customer neighbour"
).split()
MORE_WORDS = "anchor arrow basket beacon bell bench blanket bottle branch bucket button candle castle chain circle cloud compass corner crane crown desk diamond door eagle edge feather field flag flame fountain fox glass globe hammer hawk hub island jar key kite lantern leaf lens lion loop mirror moon needle nest ocean orbit owl paper path pearl pebble pilot pixel planet plaza pond portal prism pulse quarry raven ribbon rocket root sail scout seed shield signal spark spring star stone summit table thread tiger tree trail vault wave wheel willow wing yard".split()
ORG_TAILS = "Ltd Inc GmbH Group Bank Trust Labs Systems Foods Motors Partners Airlines Hospital University School Studio Media Energy Insurance Logistics Solutions Works Press Records Hotel Cafe Agency Foundation Institute Store Lab Union Council Club".split()
PLACE_TAILS = "Street Road Park Bridge Station Lake River Valley Mountain Beach Island Harbour Airport Square Tower Hall Garden Gate Hill Falls Bay City County Forest Market".split()
THINGS = "Team Project Model Phase Version Room Building Windows Galaxy Office Studio Plan Unit Line Flight Chapter Section Monday Tuesday Friday March April June Summer Winter North South Central Grand New Old Blue Red Green Happy Dear Senior Vice General Annual".split()
ROLES = "Manager President Director Engineer Edition Report Update Week Birthday Guide Series Release Customer Support Sales Marketing Desk Board Committee Meeting Plan Drive Mail Calendar Store Cloud Server".split()

#: {slots} in capitals are items; the others fill in what is none.
TEMPLATES = [
    # names
    "Please meet {NAME} at noon.", "{NAME} will join us later.", "A walk with {NAME} on {weekday}.", "Coffee with {NAME}?", "Could you ask {NAME} whether the {word} is ready?", "The {word} was written by {NAME}.", "{NAME} and {NAME} share the {word}.",
    "My name is {NAME}.", "My name is {NAME} and I need help with a {word}.", "This is {NAME} speaking.", "I am {NAME}, the new {word} lead.", "Regards,\n{NAME}", "Best wishes\n{NAME}\n{PHONE}", "Sincerely, {NAME}", "Dear {NAME}, thank you for the {word}.", "Dear Mr. {NAME},\nthe {word} has arrived.",
    "I talked to Dr. {NAME} about the {word}.", "Mrs. {NAME} is our new neighbour.", "Prof. {NAME} gave a talk on the {word}.", "Bitte Herr {NAME} Bescheid geben.", "Frau {NAME} hat angerufen.", "Monsieur {NAME} est arrivé.", "cc {NAME}", "cc: {NAME}, {NAME}", "FYI {NAME}: the {word} is late.", "Attn: {NAME}",
    "{NAME} rang twice today.", "{NAME} wrote back this morning.", "Contact person: {NAME}", "Owner: {NAME}", "Name: {NAME}\nPhone: {PHONE}", "Patient {NAME} was seen on {date}.", "The keys are with {NAME}.", "It was {NAME} who found the {word}.", "signed by {NAME} on {date}", "Give the {word} to {NAME} please.",
    "tell {NAME} that I said hi", "Our neighbour {NAME} has a spare {word}.", "She married {NAME} in {year}.", "we should thank {NAME} for the {word}", "According to {NAME}, the {word} is fine.", "Witness: {NAME}", "Signed: {NAME}", "{NAME} | {EMAIL}", "{NAME}\n{PHONE} | {EMAIL}", "{NAME}\n{PHONE}\n{EMAIL}", "{NAME} <{EMAIL}>",
    "Customer {NAME} called about the {word}.", "spoke to {NAME} yesterday", "I heard from {NAME} that {org} is hiring.", "{NAME} works at {org}.", "{NAME} of {org} sent a {word}.", "{NAME}, {address_word}", "Say hello to {NAME} from me.", "The form names {NAME} as the tenant.", "{NAME} moved to {place}.",
    # no names
    "{org} has sent the {word}.", "The {word} from {org} is late.", "We met at {place} on {weekday}.", "{thing} is on sale.", "The {thing} starts on {date}.", "Is the {word} from {org} still good?", "{place} is closed today.", "Two {word}s were bought from {org} for {money}.", "Note: {thing}, {thing} and the {word}.", "I work for {org}.",
    "{org} and {org} will merge.", "Our {thing} meets at {place}.", "Happy Birthday to you all!", "Good Morning everyone, the {word} is here.", "Welcome to {place}.", "The trip to {place} takes {num} hours.", "{org} moved the {word} to {weekday}.", "Ask {org} for a {word}.", "we changed from {org} to {org} last year", "thanks to {org} the {word} works",
    "Nobody at {org} answered.", "According to {org}, {num} {word}s are left.", "{weekday} Morning is fine.", "Install {thing} {version} first.", "{org} keeps the {word} for {num} days.", "The {word} at {place} costs {money}.", "cc {org}", "The Senior Manager and the Vice President were there.", "{org} confirmed our {word} by hand on {weekday}.", "It is {num} now and {org} likes it.", "If {org} is willing, we go.", "I noted that {org} tested the {word}.", "one {word} at {org}, one at {place}", "Can you book the {word} for {org} soon?", "It was bought from {org} last year.", "We gave up {org} for the {word} as it was slow.", "the {num} at {org} is fine", "site={org}; count={num}", "best match {org} ({weekday})", "The {org} model fits.", "goes to {org}.", "{org}: {num} notes", "I copied it at {org} by hand.", "Yesterday {org} and {org} wanted the {word}.", "the {word} of {org} was {decimal}", "As {org} said, wait.", "Where is {org}?", "Last year {org} paid {money}.", "Remember that the {word} belongs to {org}.",
    # emails
    "Write to {EMAIL} for details.", "Please use {EMAIL} only.", "My email is {EMAIL}.", "You can mail me at {EMAIL}, thanks.", "Email: {EMAIL}", "Contact {EMAIL} if the {word} fails.", "{EMAIL} is my new address.", "send it to {EMAIL} by {weekday}", "From: {EMAIL}\nTo: {EMAIL}", "<{EMAIL}>", "The account {EMAIL} was locked.", "the mail to {EMAIL} came back", "Reply to {EMAIL}!", "mailto:{EMAIL}",
    # no emails
    "Ping {handle} about it.", "{num} @ {money} each.", "The {word} is at {place} dot on time.", "Thanks {handle}, see you at {time}.", "git clone {repo}", "The picture {picture} is missing.", "We are at dinner dot com is a funny name.", "Bring {num} {word}s @ {time}.", "look at dot plots at home", "The {word} for {org} stands at {decimal} as of {date}.", "{word}s are at {decimal} now", "sold at {money}.", "It was rated at {version} by {org}.", "We start at {time}.{num} sharp.", "The {word} is at {word}.{word} level", "at {num}.{num} the {word} stops", "shares of {org} closed at {decimal} on {weekday}", "Look at {word}.txt first", "{word} at {decimal} each", "meet me at {place} at {time}",
    "{num} @ {decimal} a piece", "we took {num} @ {decimal}", "price: {num} @ {decimal}", "bought {num} @ {decimal} from {org}", "Ask {handle}, {num} @ {decimal} each.", "Total {num} @ {decimal}, thanks", "{num} {word}s @ {decimal}", "(only {num} @ {decimal})", "order of {num} @ {decimal} is in", "stock: {num} @ {decimal} per {word}",
    "git remote add origin {repo}", "see {repo} for code", "I pushed to {repo} today", "use {picture} instead", "replace {picture} by {picture}", "icons: {picture}", "it is at {decimal} today", "closed at {decimal} again", "the {word} stays at {decimal}.", "priced at {decimal} per {word}", "opened at {decimal} and fell", "he is at dot and dash school", "at home dot by dot",
    # phones
    "You may try {PHONE} again later.", "Call {PHONE} before six.", "Call me on {PHONE}.", "My number is {PHONE}.", "Tel: {PHONE}", "Phone: {PHONE}, fax: {PHONE}", "Desk {PHONE}", "Mobile {PHONE}", "Text {PHONE} when you arrive.", "You can reach {NAME} under {PHONE}.", "WhatsApp: {PHONE}", "The plumber's number: {PHONE}", "ring {PHONE} after lunch", "She left {PHONE} as her number.", "(phone {PHONE})", "Hotline {PHONE} is free of charge.", "Telefon {PHONE}", "Tél. {PHONE}", "{PHONE} is my new number.", "If you are lost call {PHONE} or {PHONE}.", "Fax {PHONE}", "{PHONE} works best in the evening.",
    # ids
    "SSN: {ID}", "the SSN {ID} is wrong", "Social security number {ID}", "The passport number is {ID}.", "Passport {ID} expires in {year}.", "passport no: {ID}", "Her national ID is {ID}.", "National insurance {ID}", "NI number: {ID}", "Tax number {ID} is needed for the {word}.", "tax ID {ID}", "My identity card number is {ID}.", "ID card {ID}", "Driver's licence {ID}", "The personal identity number {ID} was checked.", "DNI {ID}", "CPF {ID}", "Personnummer {ID}", "Steuer-ID: {ID}", "Numéro de sécurité sociale: {ID}", "his social is {ID}", "Citizen number: {ID}", "insurance number {ID}", "Please confirm your social security number, {ID}, in writing.", "personal number {ID}",
    # numbers that are neither
    "Order {order} is on its way.", "Your order number is {order}.", "Invoice {order} for {money}", "Ticket {order} was closed.", "Part no. {order}", "Serial {order}", "The tracking code is {order}.", "ISBN {isbn}", "Flight number {order} leaves at {time}.", "Log {stamp} error code {num}.", "{stamp} INFO {word} started {num}", "Version {version} from {date}.", "Server {ip} answered.", "host {ip} is down", "The router at {ip} runs {version}.", "ping {ip} from {ip}", "{ip} was blocked", "connect to {ip} on port {num}", "The box replied on {ip} after {version} came.", "It happened on {date} at {time}.", "between {date} and {date}", "Coordinates {coord}, {coord}", "The {word} costs {money} or {money}.", "commit {hash} broke it", "The score was {num}-{num}.", "Batch {order} was sold.", "Room {num}, building {num}", "Items {num} to {num}", "{num} of {num} {word}s passed.", "IBAN {iban}", "Card ending in {num}", "Case {order} was opened on {date}.", "On {date} we shipped {num} {word}s.", "Model {order} was recalled.", "(see {date})", "as of {date}", "Meter reading {order}", "Reference: {order}", "account {order} is open", "The {word} has {num} pages, {num} pictures.",
    # addresses
    "We live at {ADDRESS}.", "I moved to {ADDRESS} last year.", "Home address: {ADDRESS}", "Ship the {word} to {ADDRESS}.", "Send it to {ADDRESS} please.", "Address: {ADDRESS}", "My office is at {ADDRESS}.", "The parcel for {NAME}, {ADDRESS} came back.", "Deliver to:\n{NAME}\n{ADDRESS}", "Pick us up at {ADDRESS}.", "The flat in {ADDRESS} is to let.", "Return to {ADDRESS} if found.", "{ADDRESS}", "He gave {ADDRESS} as his address.", "Meet at {ADDRESS} at {time}.", "Wir wohnen in der {ADDRESS}.", "J'habite au {ADDRESS}.", "Billing address {ADDRESS}", "Post to {ADDRESS}, thanks.", "the house at {ADDRESS} was sold", "Lives at {ADDRESS}", "she lives at {ADDRESS}", "we are at {ADDRESS}", "Find us at {ADDRESS}", "New address: {ADDRESS}", "Office: {ADDRESS}", "my place is {ADDRESS}",
    # no addresses
    "{num} {word}s on {thing} Drive, about {order_five} {word}s.", "{num} new {word}s, then {order_five} {thing}.", "Take the {num} bus to {place}, {num} minutes.", "{num} long ways to place {order_five} Orders.", "The {num} km road, {order_five} cars a day.", "Drive {num} miles, {word} {order_five} times.", "In {year} {thing}, code {postcode_like} was used.", "Table {num} - {thing} {order_five} and more.", "box {num} of {order_five} {word}s", "{num} square metres - {money}, {order_five} sold", "Street View has {num} pictures of {place}.", "line {num}, {word} {order_five} Errors",
    # plain
    "The {word} is ready.", "I can't find the {word}.", "Let us look at the {word} again on {weekday}.", "Could you send the {word} tomorrow?", "We tested {num} {word}s.", "The {word} and the {word} are fine.", "Why is the {word} late?", "I would rather wait for the next {word}.", "it rains and the {word} is wet", "Bring {word}, {word} and the {word}.", "{word}, {word} and a {word} are left", "Nobody knows the {word}.", "There are {num} {word}s.", "Here is the plan: {word} first.", "Please wait for the {word}.", "Last time the {word} broke.", "How do you like the {word}?", "Done: the {word} works.", "Remember the {word}.", "Between the {word} and the {word}, take one.", "It looks fine.", "Our {word} was moved.", "We did it.", "You could help.", "Earlier the {word} was red.", "What is a {word}?", "def {coined}(x):\n    return {coined} + {num}", "{coined} = {num} * {coined}", "the {coined} is a new word", "a {coined} {word} and a {coined} {word}", "the {word} and the {more_word} are by the {more_word}", "an old {more_word} on a {more_word}", "her {more_word} has a {more_word}", "a {more_word} for the {more_word}", "They met at the {word} at dinner, at last at home.", "Be at {place} at {time} and look at {word}.com maybe", "That leaves {num} {word}s for {weekday}.", "Sometimes the {word} stops for {num} seconds.",
]

ID_CUES = "social security number|SSN|passport number|passport no.|passport|national ID|national identity number|tax ID|tax number|taxpayer number|identity card number|ID card|ID number|personal number|personal identity number|national insurance number|insurance number|NI number|driving licence|driver's license no.|residence permit|citizen number|DNI|NIF|CPF|Personnummer|Steuer-ID|Ausweisnummer|numéro de sécurité sociale|codice fiscale".split("|")
PHONE_CUES = "phone|phone number|telephone|tel|tel.|mobile|mobile number|cell|fax|office line|home number|hotline|WhatsApp|direct line|Telefon|Handy|téléphone|teléfono|landline|desk".split("|")
EMAIL_CUES = "email|e-mail|mail|address|my mail|contact|new email|work email|E-Mail|correo|courriel|login|user name|account|sender|recipient|reply to|write to|mail me at|send it to|ask at|reach us at|reachable under|forwarded from|message from|invite|cc|notify|subscribe".split("|")
OTHER_CUES = "order|order number|invoice|ticket|part no.|serial number|serial|tracking code|reference|ref.|batch|case|item|account|model|booking|customer number|SKU|code|build|job|shipment|entry|receipt|meter reading|contract|policy|claim".split("|")
CUED = [
    (c, k) for k, cue in (("ID", "id_cue"), ("PHONE", "phone_cue"), ("order", "other_cue"), ("EMAIL", "email_cue"))
    for c in ("My %s is {%s}.", "%s: {%s}", "%s {%s}", "The %s {%s} was checked.", "Please note the %s {%s} for later.", "her %s, {%s}, is new", "(%s {%s})", "%s {%s} is wrong", "is {%s} your %s?", "We need the %s. It is {%s}.", "the %s on the form is {%s}", "Your %s {%s} has changed.")
    for _ in (0,)
]
_SLOT = {"ID": "{id_cue}", "PHONE": "{phone_cue}", "order": "{other_cue}", "EMAIL": "{email_cue}"}
TEMPLATES += [c % ((k, _SLOT[k]) if c.startswith("is {") else (_SLOT[k], k)) for c, k in CUED for _ in range(2)]
FOLDS = 4


def fold_of_template(k: int) -> int:
    """Templates fall into FOLDS parts; each part has names, firms and towns of its own."""
    return random.Random(k).randrange(FOLDS)


_SYLLABLES = [(a + b, c) for a in "b br ch d dr f g gr h j k kl l m n p pr r s sk st t th tr v w z".split() for b in "a e i o u ae ai au ei ia ou".split() for c in ("", "n", "r", "l", "s", "k", "m", "rt", "nd", "x")]


def invented(rng: random.Random, parts: int = 2) -> str:
    """A word of syllables that is in no dictionary."""
    w = "".join("".join(rng.choice(_SYLLABLES)) for _ in range(parts))
    return w.capitalize()


class Maker:
    """Fills slots. Names and firms are partly common and partly invented; the tails of firms recur with many heads, as in real text."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        pool = lambda n, parts=2: [[invented(self.rng, parts) for _ in range(n)] for _ in range(FOLDS)]
        self.pools = {"families": pool(400), "givens": pool(400), "tails": pool(40, 1), "towns": pool(80), "heads": pool(150)}
        part = lambda xs: [[x for i, x in enumerate(xs) if i % FOLDS == f] for f in range(FOLDS)]
        self.common = {"givens": part(GIVEN), "families": part(FAMILY), "towns": part(TOWNS)}
        self.fold = 0

    def pick(self, key: str, invented_share: float = 0.55) -> str:
        r = self.rng
        return r.choice(self.pools[key][self.fold] if key not in self.common or r.random() < invented_share else self.common[key][self.fold])

    def tail(self) -> str:
        """The second word of a firm: a usual one, an invented one or an ordinary word; some recur often, others hardly."""
        r = self.rng
        u, place = r.random(), r.random() ** 2.5
        if u < 0.3:
            return r.choice(ORG_TAILS)
        if u < 0.6:
            return self.pools["tails"][self.fold][int(40 * place)]
        own = [w for i, w in enumerate(WORDS + MORE_WORDS) if i % FOLDS == self.fold]
        return own[int(len(own) * place)].capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def shaped(self, shape: str) -> str:
        """9 is a digit, N one that isn't 0, X a letter."""
        return "".join(self.rng.choice("0123456789") if c == "9" else self.rng.choice("123456789") if c == "N" else self.rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "X" else c for c in shape)

    def name(self) -> str:
        r = self.rng
        g = self.pick("givens")
        f = self.pick("families")
        u = r.random()
        if u < 0.08:
            f = f"{f}-{self.pick('families')}"
        if 0.08 < u < 0.16:
            g = f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}."
        elif 0.16 < u < 0.26:
            f = f"{r.choice('van von de del di da el bin la zu'.split())} {f}"
        elif 0.26 < u < 0.28:
            f = f"{r.choice(['van der', 'van den', 'de la'])} {f}"
        full = f"{f}, {g.split(' ')[0]}" if 0.28 < u < 0.34 and " " not in f else f"{g} {f}"
        v = r.random()
        return full.upper() if v < 0.06 else full.lower() if v < 0.14 else full

    def email(self) -> str:
        r = self.rng
        g, f = self.pick("givens").lower(), self.pick("families").lower()
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{g}{r.randrange(100)}", f"{g}-{f}", f"{f}+{r.choice(WORDS)}", "info", "support", f"{g}"])
        host = r.choice([invented(r).lower(), f"{invented(r).lower()}-{invented(r).lower()}", "gmail", "outlook", "posteo", f"mail.{invented(r).lower()}", f"post.{invented(r).lower()}"])
        top = r.choice("com com com org net de fr co.uk io edu test example invalid es it eu".split())
        u = r.random()
        at, dot = ("@", ".") if u < 0.7 else r.choice([(" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), ("＠", "."), (" @ ", "."), (" {at} ", " {dot} ")])
        out = local + at + f"{host}.{top}".replace(".", dot)
        return out.upper() if r.random() < 0.08 else out

    def phone(self) -> str:
        r = self.rng
        shapes = [
            "NN9-999-9999", "(NN9) 999-9999", "NN9.999.9999", "NN9 999 9999", "+1 NN9 999 9999", "+1 (NN9) 999-9999", "1NN99999999", "1-NN9-999-9999", "020 7999 9999", "020 7999 0999", "07N99 999999", "+44 20 7999 9999", "+44 (0)N999 999999", "0044 N999 999 999", "+44 7N99 999999",
            "+49 30 N9999 999", "030/N9999999", "030 N999999", "0N99-9999999", "+49 N99 9999999", "01 99 99 99 99", "01.99.99.99.99", "+33 N 99 99 99 99", "+33N99999999", "06 99 99 99 99", "+34 6N9 99 99 99", "9N9 99 99 99", "+3539N999999", "+35319999999", "+39 0N 9999 9999",
            "+91 9N999 99999", "+81 3-9999-9999", "+61 4N9 999 999", "+48 NN9 999 999", "+55 11 9N999-9999", "0N99 99 99 99", "+31 6 N9999999", "(0N9) 99999999", "+1NN99999999", "00353N99999999",
        ]
        return self.shaped(r.choice(shapes))

    def id_number(self) -> str:
        return self.shaped(self.rng.choice(["999-99-9999", "999 99 9999", "999.99.9999", "999999999", "XX999999X", "XX999999X", "XX 99 99 99 X", "XX 99 99 99 X", "XX 99 99 99 X", "XX9999999", "X99999999", "99999999X", "999.999.999-99", "999999-99999", "999999-9999", "99999999999", "999 999 999", "X9999999X", "99 999 999 999", "9 99 99 99 999 999"]))

    def address(self) -> str:
        r = self.rng
        town = self.pick("towns", 0.65)
        town = f"{r.choice(['San', 'Bad', 'New', 'Le', 'Port', 'Sankt', 'North', 'Santa'])} {town}" if r.random() < 0.12 else town
        street = self.pick(r.choice(["towns", "heads"]), 1.0) if r.random() < 0.6 else r.choice("Oak Maple Station Church Mill Park High King Queen Garden Baker Lake Hill".split())
        no = self.shaped(r.choice(["N", "N9", "N99", "N999"]))
        sep = r.choice([", ", ", ", ", ", "\n", " - ", ",\n"])
        kind = r.random()
        if kind < 0.35:
            way = r.choice("Street Road Lane Avenue Ave Drive Boulevard Blvd Court Close Terrace Way Place St Rd Dr St. Ave. Rd.".split())
            extra = r.choice(["", "", "", "", " Apt 4", " #12", ", Suite 200", " Unit 7", " Apt. 3b", ", Flat 2"])
            side = r.choice(["", "", "", "North ", "S. ", "East ", "W "])
            end = r.choice([f"{town}, {self.shaped('XX')} {self.digits(5)}", f"{town}, {self.shaped('XX')} {self.digits(5)}-{self.digits(4)}", f"{town} {self.shaped('XX')} {self.digits(5)}", f"{town} {self.shaped(r.choice(['XN 9XX', 'XN9 9XX', 'XXN 9XX', 'XXN9 9XX', 'XN9XX']))}", f"{town}, {self.shaped(r.choice(['XN 9XX', 'XXN 9XX']))}", f"{town} {self.shaped('X9X 9X9')}"])
            out = f"{no}{r.choice(['', '', '', 'a', 'b'])} {side}{street} {way}{extra}{sep}{end}"
        elif kind < 0.5:
            out = f"{no}{r.choice(['', '', ' bis', ' ter'])}{r.choice([',', '', ''])} {r.choice(['rue', 'avenue', 'place', 'boulevard', 'impasse', 'chemin', 'allée'])} {r.choice(['de ', 'du ', 'des ', 'de la ', ''])}{street}{sep}{self.digits(5)} {town}"
        elif kind < 0.72:
            base = street.lower() if r.random() < 0.1 else street
            out = r.choice([f"{base}straße", f"{base}strasse", f"{base}str.", f"{base}weg", f"{base}platz", f"{base}allee", f"{base}gasse", f"Am {street}", f"{street} Straße", f"{base}ring", f"{base}laan"]) + f" {no}{r.choice(['', '', ' b', 'a'])}{sep}{r.choice(['', '', '', 'D-'])}{self.digits(5)} {town}"
        elif kind < 0.87:
            out = f"{r.choice(['Calle', 'C/', 'Avenida', 'Avda.', 'Plaza', 'Paseo', 'Via', 'Viale', 'Rua', 'Piazza'])} {r.choice(['', '', 'de ', 'del '])}{street}{r.choice([',', ''])} {no}{r.choice(['', '', ', 3º', ', 2ª', ', 4º B'])}{sep}{self.digits(5)} {town}"
        else:
            out = f"{r.choice(['P.O. Box', 'PO Box', 'P.O.Box', 'Box', 'Postfach'])} {self.shaped(r.choice(['N9', 'N99', 'N999', 'N9999']))}{sep}{r.choice([f'{town} {self.digits(5)}', f'{town}, {self.shaped(chr(88) * 2)} {self.digits(5)}', f'{self.digits(5)} {town}'])}"
        return out.upper() if r.random() < 0.04 else out.lower() if r.random() < 0.06 else out

    def org(self) -> str:
        r = self.rng
        head = self.pick("heads") if r.random() < 0.75 else self.pick(r.choice(["families", "towns"]), 0.3)
        out = f"{head} {self.tail()}"
        return out.lower() if r.random() < 0.06 else out.upper() if r.random() < 0.03 else out

    def slot(self, key: str) -> str:
        r = self.rng
        if key == "order":
            return self.shaped(r.choice(["9999-9999-999", "99 99 99 99", "N99999", "N9999999", "999-9999-9999999", "XX-999999", "9999 9999 9999", "N999999999", "99-999-99", "A9999999", "99999-99", "9999-9999"]))
        made = {
            "id_cue": lambda: r.choice(ID_CUES), "phone_cue": lambda: r.choice(PHONE_CUES), "more_word": lambda: r.choice(MORE_WORDS), "email_cue": lambda: r.choice(EMAIL_CUES), "other_cue": lambda: r.choice(OTHER_CUES),
            "word": lambda: r.choice(WORDS), "org": self.org, "place": lambda: f"{self.pick(r.choice(['heads', 'towns']))} {r.choice(PLACE_TAILS)}", "thing": lambda: f"{r.choice(THINGS)} {r.choice(ROLES)}", "weekday": lambda: r.choice("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()),
            "date": lambda: r.choice([self.shaped("20N9-0N-1N"), self.shaped("1N/0N/20N9"), self.shaped("2N.0N.20N9"), self.shaped("N May 20N9"), self.shaped("March N, 20N9")]), "year": lambda: self.shaped("20N9"), "num": lambda: str(r.randrange(2, 10 ** r.choice([1, 2, 3, 4]))), "money": lambda: self.shaped(r.choice(["N9.99", "$N99", "N,999.99 EUR", "£N9"])),
            "time": lambda: self.shaped("1N:N9"), "stamp": lambda: self.shaped("20N9-0N-1N 1N:N9:N9"), "version": lambda: self.shaped("N.N.9"), "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "coord": lambda: self.shaped("N9.99999"), "hash": lambda: "".join(r.choice("0123456789abcdef") for _ in range(10)), "isbn": lambda: self.shaped("978-N-9999-9999-9"),
            "iban": lambda: self.shaped("DE99 9999 9999 9999 9999 99"), "handle": lambda: "@" + r.choice([invented(r).lower(), f"{invented(r).lower()}-desk", f"{invented(r).lower()}_{r.randrange(99)}"]), "repo": lambda: f"git@{invented(r).lower()}.com:{r.choice(WORDS)}.git", "picture": lambda: f"{r.choice(WORDS)}@2x.png",
            "decimal": lambda: f"{r.randrange(1000)}.{r.randrange(100)}", "coined": lambda: invented(r).lower(), "order_five": lambda: self.digits(5), "postcode_like": lambda: self.shaped("XX9 9X"), "address_word": lambda: r.choice(["our tenant", "the director", "a nurse", "who lives next door"]),
        }
        return made[key]()

    def sentence(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, items, at = "", [], 0
        makers = {"NAME": self.name, "EMAIL": self.email, "PHONE": self.phone, "ID": self.id_number, "ADDRESS": self.address}
        kinds = {"NAME": "name", "EMAIL": "email", "PHONE": "phone", "ID": "id_number", "ADDRESS": "address"}
        for m in re.finditer(r"\{(\w+)\}", template):
            out += template[at : m.start()]
            got = makers[m[1]]() if m[1] in makers else self.slot(m[1])
            if m[1] in kinds:
                items.append((len(out), len(out) + len(got), kinds[m[1]]))
            out += got
            at = m.end()
        return out + template[at:], items


@dataclass
class Labelled:
    text: str
    items: list[tuple[int, int, str]]
    groups: list[tuple[int, int, int]]  # where each template begins and ends, and its number


def labelled(n: int, seed: int = 0) -> list[Labelled]:
    """n texts of one to four sentences each."""
    make, out = Maker(seed), []
    r = make.rng
    for _ in range(n):
        text, items, groups = "", [], []
        for _ in range(r.randrange(1, 5)):
            k = r.randrange(len(TEMPLATES))
            make.fold = fold_of_template(k)
            s, found = make.sentence(TEMPLATES[k])
            if text:
                text += r.choice([" ", " ", " ", "\n", "  ", "\n\n"]) if text[-1] in ".!?" else r.choice(["\n", " ", " "] if items and items[-1][1] == len(text) else ["\n", ". ", " "])
            items += [(a + len(text), b + len(text), kind) for a, b, kind in found]
            groups.append((len(text), len(text) + len(s), k))
            text += s
        out.append(Labelled(text, items, groups))
    return out
