"""The small labelled table of problem 5: sentences with marked mentions, and plain ones.

Rows are made by rule with a fixed seed, from word lists and frames written for this table from
general knowledge; no sentence and no part of a name was taken from the tables of the project.
A slot in braces is a mention: P person, E email, F phone, A address, I identity number (after its
label N). ``{T}`` is a title or nothing, which is not part of a name. R a relation (cousin, tutor); G is a sentence of a small
grammar in which any noun phrase may be a person, Y a place or institution, S a street without
number, W a rare word, D a figure that identifies nobody.

Everything comes in two halves, ``part`` 0 and 1, that share no name, no street, no host and no frame:
the model is trained on one and tried on the other (``labelled(part=...)``); production uses both.
"""

from __future__ import annotations

import random
import re

# Frames. Every second one belongs to the second half.
FRAMES = """
Kindly forward the invoice to {E}.
Drop us a line at {E} any weekday.
E-mail: {E}
For a refund contact {E} within ten days.
Her new email is {E}, the old one bounced.
Subscribe by sending a blank message to {E}
My address is {E} so please use that.
Bookings via {E} or telephone {F}.
To unsubscribe, tell {E} and we will stop.
He signs everything with {E} these days.
If the link fails, {E} will sort it out.
reach me: {E} / {F}
Feedback goes to {E}; complaints go to {E}.
Send photos ({E}) before the deadline.
Helpline {F}, open all day.
Phone: {F}
Mobile {F}
My landline is {F} and my mobile is {F}.
Dial {F} and press two.
He left {F} on the answering machine.
Leave a message on {F} please
Fax the contract to {F}.
The poster listed {F} as the contact number.
WhatsApp {F} for directions.
In an emergency, ring {F} at once.
sms {F} or email {E}
Office hours: {F} (mornings), {F} (evenings).
Whoever found the wallet should phone {F}.
Home address: {A}
She lives at {A} with two cats.
The surgery has moved to {A}.
Visit us at {A}, right behind the chapel.
Please post the forms to {A}.
They delivered the piano to {A} on Tuesday.
Ship to: {T}{P}, {A}
Return address: {A}
The party is at {A}, bring snacks.
Smoke was seen coming from {A} last night.
He was born at {A} and never left.
Residents of {A} complained about the noise.
Meet me outside {A} at six.
{A} is for sale again.
The taxi stopped in front of {A}.
Her {N} is {I}.
{N}: {I}
My {N} {I} has expired.
Please quote your {N} ({I}) in every letter.
The applicant, {N} {I}, withdrew.
We could not match {N} {I} with any record.
The officer wrote down {N} {I} and waved us through.
Enter {N} {I} on line nine.
He read out his {N}, {I}, over the phone.
A copy of {N} {I} is attached.
Name: {T}{P}
Student: {T}{P}, {N} {I}
Author: {T}{P}
Written by {T}{P}
Submitted by: {T}{P}\nTutor: {T}{P}
Hello {T}{P},
Hi {P}, how are you?
Dear {T}{P} and {T}{P},
Best regards,\n{P}
Cheers,\n{P}
Love, {P}
Sincerely yours,\n{T}{P}\n{A}\n{F}
Kind regards\n{P}\n{E}
{P}: are you coming tonight?
{P}: no idea, ask {P}.
[{P}] I will bring the salad.
<{P}> lol same here
"We ought to leave," said {T}{P}.
"Nobody told me," {P} replied.
{P} laughed and shook hands with {T}{P}.
My friend {P} plays the cello.
My {R} {P} plays chess.
The parcel is for my {R} {T}{P}.
We visited her {R} {P} in spring.
His {R} {P} and my {R} {P} are twins.
Our {R}, {T}{P}, was late.
Their {R} {T}{P} called us at noon.
{P}, my {R}, drove the van.
{P} and his {R} {P} came along.
Send it to {T}{P}, {A}.
Parcel for {T}{P}, {A}.
To {T}{P}, {A}, {F}
{P}, {A}, {F}
{P} {A}
In this episode {P} opens a shop.
In the last scene {T}{P} sings.
My neighbour {T}{P} keeps bees.
Our coach, {T}{P}, resigned.
His aunt {P} baked it.
Their landlord {T}{P} raised the rent.
A man called {P} was waiting.
I was named after {P}, my grandmother.
The minutes were taken by {T}{P}.
Present: {T}{P}, {T}{P}, {T}{P}
Speakers include {T}{P}, {T}{P} and {T}{P}.
Thank you {P} for the lift home.
This report was prepared for {T}{P}.
Have you seen {P} lately?
I sat between {P} and {P}.
{P}'s bicycle was stolen.
We borrowed {P}'s tent and {P}'s stove.
{P} ({F}) is in charge of the raffle.
{P} <{E}>
{P}, {E}
From: {P}\nTo: {P}\nSubject: rent
Patient: {P}\nAddress: {A}\nPhone: {F}
Emergency contact: {P} ({F})
Her doctor, {T}{P}, can be reached on {F}.
{P} of {A} won the raffle.
Witness: {T}{P}, living at {A}, tel. {F}.
{P} (born in 1984) moved here in 2006.
For tickets ask {P} or {P}.
Nobody but {P} knew the code.
When {P} arrived, {P} had already gone.
According to {T}{P}, prices will rise.
because {P} always forgets the keys
It belongs to {P}.
The prize went to {P} for a poem.
Both {P} and {P} were absent.
Ask for {T}{P} at reception.
On Monday {T}{P} called twice.
{T}{P} teaches chemistry and {T}{P} teaches art.
{G} {P} did not reply.
{G} Call {F}. {G}
{G} Mail {E}. {G}
{G} We drove to {A}. {G}
{G} Signed, {P}
{P} {G}
Sender {T}{P} {A} {F} {E}
Tel. {F}, fax {F}, mail {E}
Contact person: {T}{P}, phone {F}, mail {E}
{P}, {A}
{P}\n{A}
Owner {P}, {N} {I}.
{P} wrote that {G}
{G} wrote {P}.
{G} ({P})
{G} — {P}
Chairman {P} opened the meeting; secretary {P} kept the notes.
cc {E}, {E}
Attn: {T}{P}
c/o {T}{P}, {A}
Signed: {P}, {P}
Best wishes, {T}{P}
Guest list: {P}, {P}, {P}, {P}.
In part two, {P} meets a stranger.
After the match {P} apologised.
In the garden {P} was humming a tune.
At the next stop {P} got off.
During the lecture {P} fell asleep.
Before the exam {P} felt ill, after it {P} was fine.
In the film {P} plays a nurse.
The solo was sung by {P} at the end.
The cake was made by {P} for the fair.
Hand the keys to {T}{P}, please.
Give this to {T}{P} in person.
They spent a month with {P} by the sea.
She danced with {P} all evening.
{P}'s voice was heard in the hall.
{P}'s plan worked on a Sunday.
Those words were {P}'s.
I know {P} from work, and {P} from school.
Her sister {P} moved to {A} in May.
Our host {P} lives at {A}.
He gave my number as {F}.
The number is {F}.
You may call me on {F} whenever you like.
I changed {F} to {F}.
Her {N} {I} was misprinted.
The passenger gave {N} {I} at the desk.
Check {N} {I} again.
Finally {P} found the courage to speak, and {P} listened.
""".strip().split("\n")
PLAIN = """
The {Y} was closed for repairs.
We changed trains at {Y}.
He studied at {Y} for three years.
The exhibition at {Y} runs until {D}.
She moved from {Y} to {Y} as a child.
A concert in {Y} was cancelled.
The yacht {W} sank off the coast.
The ferry {W} sails twice a week.
They named the trophy the {W} Shield.
The {W} Award goes to young writers.
We strolled along {S} until dark.
Shops on {S} close early.
Turn left into {S}, then right.
The tram runs down {S} every {D} minutes.
It happened in {D}.
The final score was {D}.
Pages {D} are missing.
It costs {D} pounds.
Around {D} people signed up.
Serial code {D}
Item {D} is out of stock.
Chapter {D}: {W} and the sea
{D} {W}
Gate {D} opens at {D}.
Tickets from {D} euros.
The meeting starts at {D} and ends at {D}.
Flight {D} was delayed.
See section {D} for details.
Version {D} fixes the bug.
Measured {D} by {D} metres.
Room {D}, third floor
The recipe needs {D} grams of flour.
ISBN {D}
Order {D} shipped on {D}.
Follow us @{W} for updates
The login page is at www.{W}.test/help
Open {W}@2x or {W}.txt to see the image.
We met @ the corner of {S}.
Invoice no. {D} was paid.
Reference number {D}
The part number {D} is printed below.
Batch {D} was recalled.
Catalogue number {D}, second edition
This novel has ISBN {D} inside.
ISBN-13: {D}
The bar code reads {D}.
Article {D} sold for {D} pounds.
Sample {D} was lost in {D}.
The tram number {D} goes there.
Read questions {D} and {D}.
{D} out of {D} voters agreed.
Despite the rain, {G}
Describe the picture in {D} words.
Pick the right option.
Sounds like a plan.
Underline every verb and copy the nouns.
Vice versa, {G}
Ad hoc and de facto are Latin.
[laughter] And that was that.
(applause)
{D} and then we go on {D} to the next one
To whom it may concern:
Dear colleagues, please read this.
Dear Sir or Madam,
Kind regards, the editors
Yours, a neighbour
Thank you for reading.
Ladies and gentlemen, welcome.
In Spanish class we learned a song.
On Sunday and Monday in July it rained.
The French and the German teams drew.
Christmas and Easter are holidays.
NASA and the BBC published figures.
The Second World War ended in {D}.
Table of Contents
The Art of Slow Cooking
INTRODUCTION
Conclusion: {G}
{W} is a rare word.
{W} {W} {W}.
The word {W} means a small boat.
{W} grew near the river, and {W} too.
Dictionary: {W}, noun
The Lake {W} region is quiet.
Mount {W} is high.
The River {W} floods in spring.
{G}
{G} {G}
{G} {G} {G}
— {G}
* {G}
{D}. {G} {D}. {G}
{D} {G}
Müller bedeutet Beruf, das Buch liegt auf dem Tisch im Garten.
Der Hund schläft unter dem Baum. Die Katze sieht den Vogel am Himmel.
Im Winter fahren viele Leute mit dem Zug in die Berge.
Le chat dort sur la chaise. Les enfants mangent une pomme dans la cuisine.
Nous avons mangé du pain avec du fromage hier soir.
El perro corre por la playa. Los niños comen manzanas en la cocina.
La lluvia cae sobre las montañas y el pueblo duerme.
Il gatto dorme sulla sedia mentre la pioggia cade.
De kat slaapt op de stoel en het regent buiten.
Собака спит под деревом. Кошка смотрит в окно.
Η γάτα κοιμάται κάτω από το τραπέζι.
Well, {G}
Moreover, {G}
Last year, {G}
First, {G} Then {G}
What a day! {G}
Why? Because {G}
""".strip().split("\n")

# Given names and surnames of many languages. Every second one belongs to the second half.
GIVEN = (
    "Agnes Alban Alejandra Alistair Ambrose Anders Angharad Anselm Aparna Arjun Arvid Astrid Babajide Barnaby Beatrix Benedikt Bettina Birgit Bogdan Brunhilde "
    "Callum Candice Carlotta Cedric Chidi Chiyo Clementine Conrad Cordelia Cosimo Dagmar Damaris Deirdre Delphine Desmond Dimitra Dolores Dominika Dorothea Duncan "
    "Ebba Edmund Eleni Eliska Emilio Enrique Esperanza Eugenia Fabrizio Fatou Felicity Fergus Fiorella Florian Frieda Gareth Genevieve Gertrude Giacomo Gideon "
    "Giulia Graciela Gunnar Guillermo Hector Hedwig Helmut Hiroshi Horatio Hortense Hyacinth Ibrahim Ignacio Imogen Ingrid Isidora Ivana Jacinta Jaromir Jasper "
    "Jemima Joachim Jocelyn Josefina Kamala Kasimir Katarzyna Kazuo Kenneth Kerstin Khadija Kieran Klaus Kwame Lachlan Lakshmi Laszlo Leocadia Leopold Lorcan "
    "Lorenzo Lucinda Ludmila Magnus Malcolm Manuela Marcello Margarethe Marisol Maximilian Meredith Mikhail Millicent Minako Morag Mustafa Natasha Nathaniel Ngozi Nikolai "
    "Octavia Olumide Ottoline Padraig Pascal Penelope Percival Petronella Philippa Quentin Rafaela Ramona Randolph Reginald Rohan Roderick Rosamund Rupert Salvatore Sanjay "
    "Seamus Sebastian Shanice Siegfried Simone Sophronia Stanislaw Svetlana Tabitha Takeshi Tamsin Tatiana Thaddeus Theodora Tiberius Ulrich Ursula Valentina Vanessa Veronika "
    "Vikram Wilhelmina Winifred Xiomara Yasmin Yevgeny Yolanda Zachary Zdenka Zuleika"
).split()
FAMILY = (
    "Abernathy Achterberg Adebayo Aguirre Albescu Andrianov Appleyard Arrowsmith Ashworth Baczynski Balakrishnan Bannister Barrowclough Beauchamp Bellingham Bergstrom Bianchi Birkinshaw Bjornstad Blackwood "
    "Bonaventure Boszormenyi Braithwaite Brandvold Brzezinski Buchanan Bustamante Cadwallader Calderon Carmichael Castellano Chakrabarti Chamberlain Cholmondeley Christodoulou Clutterbuck Cunningham Czajkowski "
    "Dalgaard Debenham Delacroix Dimopoulos Dombrowski Donnelly Drummond Dubois Eastwick Ekwueme Ellingham Engelbrecht Escobedo Espinoza Fairweather Featherstone Ferreira Fitzgerald Fotheringay Friedrichsen "
    "Gallagher Garibaldi Giannopoulos Gillespie Goldschmidt Gonzalez Goodenough Grabowski Greenhalgh Grosvenor Gudmundsson Gutierrez Habsburger Haraldsen Hathaway Hawthorne Hendricks Higginbotham Hirschfeld Holloway "
    "Iglesias Ingebrigtsen Ivanenko Jablonski Jefferson Johansson Kaczmarek Karamanlis Kawamoto Kensington Kirkpatrick Klostermann Kobayashi Kovalenko Krishnamurthy Kuznetsov Lafontaine Lagerkvist Lancaster Lefebvre "
    "Leibowitz Lindqvist Livingstone Lombardi Lundgaard Macdonald Machado Mackenzie Makarios Mankiewicz Marchetti Mazzarella Mcallister Mcgregor Mendelsohn Middleton Mihailovic Montgomery Moriyama Mukherjee "
    "Nakagawa Natarajan Nieminen Nightingale Novotny Nwachukwu Odonnell Okonkwo Olafsson Oosterhuis Ostrander Overbeck Papadakis Pemberton Penhaligon Petrossian Pilkington Plantagenet Przybylski Quartermaine "
    "Rademacher Ramachandran Ravenscroft Richelieu Rodriguez Rosenbaum Ruthven Santangelo Satterthwaite Scattergood Schoenfeld Shackleton Silverstein Skarsgard Somerville Stavropoulos Steinhauer Subramaniam Sutherland Szczepanski "
    "Takahashi Thistlethwaite Throckmorton Toivonen Tolliver Trevelyan Tsukamoto Uchida Underhill Vandermeer Vasilenko Velasquez Villanueva Vonnegut Wackerbarth Wainscott Washington Weatherby Whittington Wojciechowski "
    "Yamashita Yarborough Zimmerman Zubizarreta"
).split()
PARTICLE = ("de ", "van ", "von ", "di ", "van der ", "al-", "O'", "Mc", "Mac", "St. ", "le ")
SYLLABLE = "ba che dri el fen gor ha ist jo kal lum mir nok or pri qua ras shi tov ul vey wil xan yor zef bren cla dov gri hul lyn mon pas rho sten tul vor".split()
TITLE = ("Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Miss ", "Dr ", "Dr. ", "Prof. ", "Professor ", "Sir ", "Captain ", "Judge ", "Pastor ", "Herr ", "Frau ", "Señora ", "Mme ")
TOWN = "Ambleford Bristlemere Cawthorne Dunmarrow Eastleigh Framwell Gatesby Hexworth Inverallan Kirkholme Lavenstoke Marchbourne Netherton Oakhampton Prestwold Rothbury Skelmere Thornaby Uppingham Whitcombe Bergheim Altstadt Montclair Villanova".split()
SITE = "University;Hospital;Library;Museum;Cathedral;Airport;Stadium;Bridge;Theatre;Grammar School;Primary School;Foundation;Institute;Gallery;Castle;Harbour;Railway Station;Concert Hall;Park;Market;Cup;Prize;Society;Council;Hotel;Inn".split(";")
ROAD = "Acacia Alder Bakers Bellevue Birchwood Cathedral Chestnut Cloister Dovecote Fountain Foundry Garrison Glebe Hawthorn Heron Ironmonger Juniper Kingfisher Laburnum Lime Maple Merchant Nursery Oaktree Palmerston Poplar Priory Rectory Sycamore Tanner Upland Vicarage Walnut Willow Windmill Yew".split()
WAY = "Street Road Lane Avenue Drive Court Close Crescent Way Place Terrace Gardens Square Hill Row Mews Grove Walk Boulevard Parade St. St Rd Rd. Ave. Ave Ln Ln. Blvd Dr. Pl. Sq. Cres".split()
HOST = "acme.test lumen.test oldmill.example northgate.example post.invalid box.invalid webpost.net fastmail.org letterbox.io uni-north.ac.uk city.gov.uk firma.de correo.es poste.fr team.startup.co alumni.college.edu mail.bakery.com".split()

DET = "the a an this that every each some another his her my our their your no one".split()
ADJ = "narrow heavy gentle bitter hollow distant cheap rusty polite curious rapid frozen golden silent clever rough modest brave stale crooked general local public recent early late long short new small great young different important".split()
NOUN = (
    "kitchen harbour lamp river cousin engine market ladder basket farmer window bridge painter island candle soldier village doctor teacher forest cabin blanket neighbour winter pupil story question answer result theory "
    "method village ticket number address phone email letter street road house card passport licence form name page line list report office school college class lesson exam student president nurse driver driver's idea problem "
    "law government system research article paragraph text word sentence language music picture film game team player company market price water food tree flower animal dog cat bird horse child mother father brother sister friend"
).split()
VERB = "carried watched repaired painted followed ignored praised remembered lifted sold borrowed wrote read counted described explained needed liked hated wanted gave showed brought helped met saw heard knew thought said told asked called is was has had can will makes takes shows".split()
ADVERB = "slowly often never again quietly usually together soon always once twice here there now then already almost perhaps really".split()
LINK = "because while although when if and but or so that which who for with near under beside against without about into from after before than during between toward since until".split()
LEAD = ("In the end, ", "For instance, ", "On the other hand, ", "At night ", "Sometimes ", "Yesterday ", "After lunch, ", "As a result, ", "Of course ", "I think that ", "They say ", "We know ", "It is clear that ", "There was ", "If so, ", "")
OPEN = ("In {} ", "At {} ", "After {} ", "During {} ", "Before {} ", "Near {} ", "With {} ", "Without {} ", "Despite {}, ", "Because of {} ")
NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred".split())
COMMON = (
    "introduction background summary conclusion findings results abstract discussion appendix contents overview notes references okay bye hey oh "
    "about above according across actually add afraid ago agree ahead all allow along already although among amount and angry answer any anyone anything apart appear area argue arm around arrive art ask attention available away back bad base "
    "be bear beat beautiful become bed begin behind believe below best better big bit black blood blue body both bottom boy break bring build building business busy buy by care carefully carry case catch cause centre certain change chapter check "
    "choose choice circle city clear close cold colour come common compare complete consider continue copy correct cost could count country course cover cross cry cut dark day dead deal dear decide deep despite develop die difference difficult dinner "
    "discuss do draw dream drink drop dry during each ear earth easy eat edge education effect either else end enjoy enough especially even event ever evidence exactly example expect experience explain eye face fact fall family far fast feel feeling "
    "few field fight fill final find finish fire fish fit fly follow foot force foreign form free full fun further future garden general get girl go god gold good ground group grow guess hair half hall hand happen happy hard hat head hear heart "
    "heavy hello help here high himself herself history hold holiday home hope hot hour house however human hundred husband if imagine important indeed inside instead interest into its itself job join jump just keep key kind king know land large last later "
    "laugh lead learn least leave left leg less let level lie life light like likely line listen live lose lot love low lunch machine main man many mark match matter may maybe mean measure meet member mention middle might mind minute miss moment money month "
    "moon moreover morning most mostly mountain mouth move much must name nature near nearly necessary need neither never nevertheless new next nice night none nor not nothing notice object off offer often oil ok once only onto open order other otherwise ought out outside "
    "over own page pain paper part particular pass past pay people period person pick piece plan plant play please point poor position possible pound power prepare present pretty probably process produce provide public pull push put quick quickly quite race rather "
    "reach ready real reason red regardless remain rest rich ride right rise rock role round rule run sad safe same sand save say science sea season seat second see seem sell send sense sentence serious serve set several shape share sharp she ship shop should shout "
    "shut side sign similar simple sing single sit size skin sky sleep smile snow so soft some son sort sound sounds south space speak special spend spring stand star start state stay step still stop strange strong study such suddenly sugar suit summer sun support suppose "
    "sure surprise sweet swim take talk tall teach tell than thank that them themselves therefore these thick thin thing this those thousand through throw thus tie till tired today tomorrow top total touch towards town trade train travel tree trip trouble true trust try turn "
    "type under understand unit unless unlike until up upon us use useful usual value various very view visit voice wait walk wall war warm wash watch way wear weather week weekend weight well west wet what whatever where whereas whether white whole whom whose why wide wife wild win "
    "wind wine wish within woman wonder wood work world worry worse would wrong year yellow yes yesterday yet young"
).split()
RELATION = "friend neighbour aunt uncle cousin brother sister mother father son daughter colleague boss teacher tutor coach doctor landlord flatmate classmate partner nephew niece grandmother grandfather pupil nurse lawyer manager assistant guest trainer dentist mentor professor captain boyfriend girlfriend wife husband".split()
LABELS = {
    "person": "Name|Student|Author|Patient|Owner|Contact|From|To|Sender|Recipient|Attn|Full name|Signed|Teacher|Guest".split("|"), "address": "Address|Home|Home address|Addr.|Lives at|Residence|Deliver to|Ship to|Location".split("|"),
    "phone": "Tel|Tel.|Phone|Telephone|Mobile|Cell|Fax|Ph|Call|Ring|Text|Number".split("|"), "email": "E-mail|Email|Mail|email|Write to|Reply to|Contact|cc".split("|"),
}
PLACED = ("in {}", "at {}", "from {}", "to {}", "near {}")


def _words(*texts: str) -> set[str]:
    return {w for t in texts for w in re.findall(r"[^\W\d_]+", re.sub(r"\{[A-Z]\}", " ", t).lower())}


#: Words that may stand in plain text: common ones, and all words of the lists above but names and places.
CONTENT = frozenset(_words(*ADJ, *NOUN, *VERB, *ADVERB, *COMMON))
ABROAD = (
    "und oder der die das ein eine nicht mit auf von zu wird haben sein ist sind war den dem im am es sie er wir aber auch noch schon immer oft sehr heute gestern morgen hier dort wenn dann weil dass viel gut klein groß früh spät schön täglich liest schreibt geht kommt macht sieht steht Hund Katze Kind Frau Mann Tür Tisch Himmel Straße Schiff Wald Fluss Brot Arbeit Freund Zeit Lehrer Regen Stein Brücke schnell langsam grün neu alt trinkt läuft",
    "et ou le la les un une du au dans pour qui que est sont était très plus mais ici hier toujours souvent petit grand beau lit écrit vient fait maison chien enfant femme homme ciel pas avec sur de vers sera avoir être forêt rivière pain travail ami temps maître pluie pierre pont vite lent vert neuf vieux boit court",
    "y o el la los un una en del al por para que es son era muy más pero aquí ayer siempre pequeño grande lee escribe viene hace casa perro niño mujer hombre cielo no con sobre hacia será tener ser bosque río pan trabajo amigo tiempo maestro lluvia piedra puente rápido lento verde nuevo viejo bebe corre",
    "e o il lo gli un una non con su di verso sarà avere essere bosco fiume pane lavoro amico tempo maestro pioggia pietra ponte veloce lento verde nuovo vecchio beve corre",
)
#: Small words of other languages; they are known, but not English.
SMALL_ABROAD = frozenset(w for s in ABROAD for w in s.split() if w.islower())
#: Words that tell of a mention, always words of their own to the model.
CUES = frozenset(_words(*FRAMES, *(x for v in LABELS.values() for x in v), *TITLE, *SITE, *WAY, *RELATION) | _words(
    "january february march april june july august september october november december tuesday wednesday thursday friday saturday english italian american british spanish chinese russian european "
    "ssn nino ni soc sec dl matric num id number no passport licence license driver student enrolment matriculation registration travel document national insurance social security driving ext extension x "
    "po box p o post office postbox flat apt unit apartment suite room floor at dot com org net edu uk co example test mailto www mail am pm isbn north south east west upper great old it they she he people everyone i we you this "
    "one two three four five six seven eight nine ten eleven twelve fifteen twenty thirty forty forty hundred thousand first second third straße weg platz allee gasse rue calle via"))
ENGLISH = (CONTENT | CUES | _words(*(x for x in PLAIN if x.isascii()), *DET, *LINK, *LEAD)) - SMALL_ABROAD | {"a", "an", "no", "on", "in", "it", "he", "we", "not", "so", "is", "am", "at", "do", "to", "of"}
WORDS = ENGLISH | SMALL_ABROAD


def half(values, part: int | None):
    """All of a list, or its even or odd entries."""
    return values if part is None else values[part::2]


class Maker:
    """Draws mentions, words and sentences of one half (or all) with one random source."""

    def __init__(self, seed: int, part: int | None):
        self.r = random.Random(seed)
        self.given, self.family, self.road, self.host, self.town = (half(x, part) for x in (GIVEN, FAMILY, ROAD, HOST, TOWN))
        self.syllable = half(SYLLABLE, part)
        self.frames, self.plain = half(FRAMES, part), half(PLAIN, part)

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def rare(self) -> str:
        """A made-up word: names of this kind too, so that spelling alone tells little."""
        r = self.r
        s = "".join(r.choices(self.syllable, k=r.choice((1, 2, 2, 3)))) + r.choice(["", "", "n", "t", "er", "ing", "ed", "s", "ly", "ness", "ish", "tion", "ment"])
        return s.capitalize() if r.random() < 0.4 else s

    def first(self) -> str:
        return self.r.choice(self.given) if self.r.random() < 0.6 else "".join(self.r.choices(self.syllable, k=self.r.choice((1, 2, 2, 3)))).capitalize()

    def last(self) -> str:
        r = self.r
        s = r.choice(self.family) if r.random() < 0.5 else "".join(r.choices(self.syllable, k=r.choice((2, 2, 3)))).capitalize()
        if r.random() < 0.06:
            return r.choice(PARTICLE) + s
        if r.random() < 0.08:
            return f"{s}-{r.choice(self.family)}"
        return s

    def person(self, titled: bool) -> str:
        r = self.r
        f, s = self.first(), self.last()
        k = r.random()
        if titled:
            name = s if k < 0.7 else f"{f} {s}" if k < 0.92 else f"{f[0]}. {s}"
        elif k < 0.42:
            name = f"{f} {s}"
        elif k < 0.52:
            name = f"{f} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {s}"
        elif k < 0.62:
            name = f"{f[0]}. {s}"
        elif k < 0.66:
            name = f"{f[0]}. {r.choice('ABCDEFGHJKLMNPRSTVW')}. {s}"
        elif k < 0.75:
            name = f"{s}, {f}"
        elif k < 0.77:
            name = f"{s}, {f[0]}."
        elif k < 0.9:
            name = f
        elif k < 0.93:
            name = f"{f} {s[0]}."
        else:
            name = s
        c = r.random()
        return name.lower() if c < 0.14 else name.upper() if c < 0.2 else name

    def email(self) -> str:
        r = self.r
        f, s = (x.lower().replace("ñ", "n").replace(" ", "") for x in (self.first(), self.last()))
        n = r.choice(["", "", "", self.digits(1), self.digits(2), str(r.randint(1950, 2012))])
        local = r.choice([f"{f}.{s}", f"{f}_{s}", f"{s}.{f}", f"{s}-{f}", f"{f[0]}{s}{n}", f"{f[0]}.{s}", f"{f}{n}", f"{s}{n}", f"{f}{s}", f"{f}+{self.rare().lower()}{n}", f"{self.rare().lower()}{n}", f"{f}.{s}{n}", "info", "office", "admissions"])
        local = local.replace("'", "").replace(". ", ".")
        host = r.choice(self.host) if r.random() < 0.6 else f"{self.rare().lower()}.{r.choice(('com', 'org', 'net', 'example', 'edu', 'co.uk', 'de'))}"
        if r.random() < 0.15:
            host = r.choice(("mail.", "post.", "students.", "lists.")) + host
        k = r.random()
        if k < 0.6:
            out = f"{local}@{host}"
        elif k < 0.66:
            out = f"{local} @ {host}"
        else:
            at = r.choice([" (at) ", " [at] ", "(at)", "[at]", " at ", " AT ", " <at> ", "{at}"])
            dot = r.choice([" (dot) ", " [dot] ", "(dot)", "[dot]", " dot ", " DOT ", " . "]) if r.random() < 0.8 else "."
            if dot == "." and at.strip().lower() == "at":
                dot = " dot "
            if r.random() < 0.3 and "dot" in dot:
                local = local.replace(".", dot)
            out = local + at + dot.join(host.split("."))
        c = r.random()
        return f"<{out}>" if c < 0.06 else out.upper() if c < 0.12 else "mailto:" + out if c < 0.15 else out

    def phone(self) -> str:
        r, d = self.r, self.digits
        a3 = str(r.randint(201, 989))
        x = r.choice([
            f"{d(3)}-{d(4)}", f"{d(3)}-{d(4)}", f"{d(3)} {d(4)}", f"{a3}-{d(3)}-{d(4)}", f"{a3} {d(3)} {d(4)}", f"({a3}) {d(3)}-{d(4)}", f"({a3}) {d(3)} {d(4)}", f"{a3}.{d(3)}.{d(4)}", f"+1 {a3} {d(3)} {d(4)}", f"+1-{a3}-{d(3)}-{d(4)}",
            f"+1 ({a3}) {d(3)}-{d(4)}", f"1-800-{d(3)}-{d(4)}", f"{a3}{d(7)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"(0{d(3)}) {d(3)} {d(4)}",
            f"(0{d(2)}) {d(4)} {d(4)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+44 {d(4)} {d(6)}", f"+44 (0){d(4)} {d(3)} {d(3)}", f"+44 (0){d(2)} {d(4)} {d(4)}", f"0044 {d(4)} {d(6)}", f"+44{d(10)}", f"0{d(10)}",
            f"+49 {d(2)} {d(6)}", f"+49 {d(3)} {d(7)}", f"0{d(3)}/{d(6)}", f"0{d(2)}-{d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+{r.randint(20, 99)} {d(3)} {d(3)} {d(3)}", f"{d(3)} {d(4)}",
        ])
        return x + r.choice([f" ext. {d(2)}", f" ext {d(3)}", f" x{d(3)}", f", ext. {d(3)}", f" extension {d(2)}"]) if r.random() < 0.14 else x

    def address(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.15:
            out = f"{r.choice(['PO Box', 'P.O. Box', 'P. O. Box', 'Post Office Box', 'P.O.Box', 'Postbox', 'P O Box'])} {r.randint(1, 9999)}"
        elif k < 0.24:
            stem, way = r.choice("Linden Berg Wiesen Schiller Rosen Mozart Goethe Bach Garten Kirchen".split()), r.choice("straße weg platz allee gasse str. strasse".split())
            out = r.choice([f"{stem}{way} {r.randint(1, 190)}", f"{r.randint(1, 190)} rue {r.choice(('de la ', 'du ', 'des '))}{self.rare().capitalize()}", f"Calle {self.rare().capitalize()} {r.randint(1, 190)}", f"Via {self.rare().capitalize()} {r.randint(1, 190)}"])
        else:
            unit = f"{r.choice(['Flat', 'Apt.', 'Apt', 'Unit', 'Apartment', 'Suite', 'Room'])} {r.choice([str(r.randint(1, 60)), r.choice('ABCDEF'), str(r.randint(1, 30)) + r.choice('abcABC')])}, " if r.random() < 0.2 else ""
            n = str(r.choice((r.randint(1, 99), r.randint(1, 999), r.randint(100, 9999)))) + r.choice(["", "", "", "", "a", "b", "A", "B", "C"])
            if r.random() < 0.1:
                n = r.choice(("", "", "", "Twenty-", "Forty-")) + r.choice(sorted(NUMBERS))
                n = n.capitalize()
            street = r.choice(self.road) if r.random() < 0.6 else self.rare().capitalize()
            lead = r.choice(("North ", "Old ", "Great ", "W. ", "East ", "Upper ")) if r.random() < 0.1 else ""
            out = f"{unit}{n} {lead}{street} {r.choice(WAY)}" + (f", {r.choice(('Apt', 'Unit', 'Flat'))} {r.randint(1, 40)}" if r.random() < 0.05 else "")
        if r.random() < 0.4:
            town = r.choice(self.town) if r.random() < 0.6 else self.rare().capitalize()
            post = r.choice([self.digits(5), f"{r.choice('BDGLMN')}{r.randint(1, 29)} {r.randint(1, 9)}{r.choice('ABDEF')}{r.choice('GHJL')}", f"{r.choice(('NY', 'TX', 'CA', 'OH'))} {self.digits(5)}"])
            out += r.choice([f", {town}", f", {town} {post}", f", {post} {town}", f", {town}, {post}"])
        c = r.random()
        return out.lower() if c < 0.08 else out.upper() if c < 0.13 else out

    def identity(self) -> tuple[str, str]:
        """(label, number)"""
        r, d = self.r, self.digits
        number = r.choice(["number", "no.", "no", "No.", "nr", "#", "", "num."])
        letter = lambda n: "".join(r.choices("ABCDEFGHJKLMNPRSTWXYZ", k=n))
        k = r.randrange(5)
        if k == 0:
            label, value = r.choice(["social security", "Social Security", "SSN", "soc. sec."]), r.choice(["{}-{}-{}", "{} {} {}", "{}{}{}"]).format(d(3), d(2), d(4))
        elif k == 1:
            sep = r.choice(["", " ", "-"])
            label, value = r.choice(["national insurance", "National Insurance", "NI", "NINO", "N.I."]), letter(2) + sep + sep.join((d(2), d(2), d(2))) + sep + r.choice("ABCD")
        elif k == 2:
            label, value = r.choice(["passport", "Passport", "PASSPORT", "travel document"]), r.choice([d(9), letter(1) + d(8), letter(2) + d(7), letter(1) + d(7), f"{letter(1)}{d(2)} {d(6)}", f"{letter(2)} {d(7)}"])
        elif k == 3:
            label = r.choice(["student", "student ID", "Student ID", "enrolment", "matriculation", "matric.", "registration", "student id"])
            value = r.choice([d(7), d(8), d(9), letter(1) + d(7), f"{letter(1)}-{r.randint(1990, 2030)}-{d(5)}", f"{letter(2)}{d(6)}", f"{d(4)}-{d(4)}", f"{r.randint(1990, 2030)}/{d(5)}", f"{letter(3)}-{d(6)}"])
        else:
            label = r.choice(["driving licence", "driver's license", "driver's licence", "drivers license", "Driving Licence", "licence", "DL"])
            value = r.choice([letter(1) + d(7), letter(1) + d(12), f"{letter(1)}{d(3)}-{d(4)}-{d(4)}", f"{letter(5)}{d(6)}{letter(2)}{d(1)}{letter(2)}", f"{letter(2)}-{d(6)}", f"{letter(1)}{d(4)}-{d(5)}", f"{letter(1)} {d(3)} {d(3)} {d(3)}"])
        return f"{label} {number}".strip() + r.choice(["", "", "", ":", " is", " was"]), value

    def figure(self) -> str:
        """Numbers of other kinds: years, dates, times, money, scores, codes, counts, ranges."""
        r, d = self.r, self.digits
        return r.choice([
            str(r.randint(1, 999)), str(r.randint(1500, 2090)), f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1950, 2030)}", f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1950, 2030)}",
            f"{r.randint(1, 23)}:{r.randint(0, 59):02}", f"{r.randint(0, 59):02}:{r.randint(0, 59):02}", f"{r.randint(1, 12)}.{r.randint(0, 59):02}", f"{r.randint(1, 900)},{d(3)}", f"{r.randint(1, 90)},{d(3)},{d(3)}", f"{r.randint(1, 90)} {d(3)}", f"{r.randint(1, 9)} {d(3)} {d(3)}",
            f"{r.randint(1, 300)}-{r.randint(1, 900)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 99)}", f"{d(4)}-{d(2)}", f"{r.choice('ABKQX')}{r.choice('ABKQX')}-{d(4)}", f"{r.choice('ABKQX')}{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            f"{r.randint(1, 99)}%", f"£{r.randint(1, 900)}.{d(2)}", f"${r.randint(1, 900)}", f"{r.randint(1, 99)}th", f"{r.randint(1, 40)} to {r.randint(41, 90)}", f"{d(3)}.{d(3)}/{d(2)}", f"{d(3)}-{d(3)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}-{d(2)}-{d(4)}", f"978-{d(1)}-{d(2)}-{d(2)}-{d(1)}", f"{r.randint(1, 99)} {r.choice(NOUN)}s", f"{r.randint(1990, 2020)}-{r.randint(1991, 2021)}", d(5),
        ])

    def place(self) -> str:
        r = self.r
        town = r.choice(self.town) if r.random() < 0.5 else self.last() if r.random() < 0.5 else self.rare().capitalize()
        return f"{town} {r.choice(SITE)}" if r.random() < 0.7 else r.choice(("the University of ", "the Bay of ", "")) + town if r.random() < 0.5 else town

    def phrase(self) -> str:
        r = self.r
        noun = r.choice(NOUN if r.random() < 0.6 else COMMON) if r.random() < 0.8 else self.rare().lower()
        return f"{r.choice(DET)} {r.choice(ADJ) + ' ' if r.random() < 0.4 else ''}{noun}"

    def sentence(self, people: float) -> list[tuple[str, str]]:
        """Pieces (text, kind) of a sentence; each noun phrase is a person with probability ``people``."""
        r, out = self.r, []

        def noun_phrase():
            if r.random() < people:
                titled = r.random() < 0.2
                if titled:
                    out.append((r.choice(TITLE), ""))
                out.append((self.person(titled), "person"))
            else:
                out.append((self.phrase() if r.random() < 0.85 else r.choice(("it", "they", "she", "he", "people", "everyone", "I", "we", "you", "this")), ""))

        lead = r.choice(LEAD) if r.random() < 0.3 else r.choice(OPEN).format(self.phrase()) if r.random() < 0.2 else ""
        out.append((lead, ""))
        noun_phrase()
        out.append((f" {r.choice(ADVERB) + ' ' if r.random() < 0.25 else ''}{r.choice(VERB)} ", ""))
        noun_phrase()
        while r.random() < 0.5:
            k = r.random()
            if k < 0.2:
                out.append((" " + r.choice(PLACED).format(self.place()), ""))
            elif k < 0.3:
                out.append((f" in {self.figure()}", ""))
            else:
                out.append((f"{',' if r.random() < 0.3 else ''} {r.choice(LINK)} ", ""))
                noun_phrase()
                if r.random() < 0.6:
                    out.append((f" {r.choice(VERB)} ", ""))
                    noun_phrase()
        out.append((r.choice("......?!;"), ""))
        k = next(i for i, (s, _) in enumerate(out) if s)
        if not out[k][1] or r.random() < 0.5:
            s = out[k][0]
            out[k] = (s[0].upper() + s[1:], out[k][1])
        return out

    def abroad(self) -> str:
        """Sentences in another language."""
        r, out = self.r, []
        words = r.choice((ABROAD[0], *ABROAD)).split()
        for _ in range(r.choice((2, 3, 4))):
            s = " ".join(r.choices(words, k=r.randint(4, 9)))
            out.append(s[0].upper() + s[1:] + r.choice("...?!"))
        return " ".join(out)

    def card(self) -> list[tuple[str, str]]:
        """A block of labelled or bare details in any order."""
        r = self.r
        joint = r.choice(("\n", "\n", ", ", "; ", " | ", " / ", " "))
        bare = r.random() < 0.3
        parts = []
        for kind in r.sample(("person", "address", "phone", "email", "id_number"), k=r.choice((2, 2, 3, 3, 4))):
            label = r.choice(LABELS.get(kind, ("",))) + r.choice((": ", ": ", " ", ". ", " = ", " - "))
            if kind == "id_number":
                name, value = self.identity()
                parts.append([(name + r.choice((" ", ": ")), ""), (value, kind)])
                continue
            titled = kind == "person" and r.random() < 0.25
            value = {"person": lambda: self.person(titled), "address": self.address, "phone": self.phone, "email": self.email}[kind]()
            parts.append([("" if bare else label, ""), (r.choice(TITLE) if titled else "", ""), (value, kind)])
        out = []
        for i, part in enumerate(parts):
            out += [(joint, "")] * (i > 0) + part
        return out + [(r.choice((".", "", "", "\n")), "")]

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        if r.random() < 0.1:
            return self.abroad(), []
        frame = r.choice(self.frames if r.random() < 0.62 else self.plain).replace("\\n", "\n")
        pieces: list[tuple[str, str]] = []
        if r.random() < 0.4:
            pieces += [*(self.sentence(0.12) if r.random() < 0.88 else [(self.abroad(), "")]), (r.choice(["\n", " ", " ", "\n\n"]), "")]
        titled, id_value, i = False, "", 0
        if r.random() < 0.1:
            pieces += self.card()
            i = len(frame)
        while i < len(frame):
            if frame[i] != "{":
                pieces.append((frame[i], ""))
                i += 1
                continue
            slot, i = frame[i + 1], i + 3
            if slot == "T":
                titled = r.random() < 0.3
                pieces.append((r.choice(TITLE) if titled else "", ""))
            elif slot == "N":
                label, id_value = self.identity()
                pieces.append((label, ""))
            elif slot == "G":
                pieces += self.sentence(0.25)
            elif slot == "P":
                pieces.append((self.person(titled), "person"))
                titled = False
            else:
                kind = {"E": "email", "F": "phone", "A": "address", "I": "id_number"}.get(slot, "")
                pieces.append(({"E": self.email, "F": self.phone, "A": self.address, "I": lambda: id_value, "Y": self.place, "R": lambda: r.choice(RELATION), "S": lambda: f"{r.choice(self.road)} {r.choice(WAY[:18])}", "W": self.rare, "D": self.figure}[slot](), kind))
        if r.random() < 0.5:
            pieces += [(r.choice([" ", " ", "\n", "\n\n"]), ""), *(self.sentence(0.12) if r.random() < 0.88 else [(self.abroad(), "")])]
        text, marks = "", []
        loud = r.random() < 0.12  # one sentence in capitals
        for s, kind in pieces:
            if s[:1] == "\n" or text[-1:] in ".!?" and r.random() < 0.5:
                loud = not loud and r.random() < 0.12
            if loud and len(s.upper()) == len(s):
                s = s.upper()
            if kind:
                lead = len(s) - len(s.removeprefix("<").removeprefix("mailto:").removeprefix("MAILTO:"))  # brackets are not part of an address
                marks.append((len(text) + lead, len(text) + len(s.removesuffix(">")), kind))
            text += s
        c = r.random()
        if c < 0.1:
            text = text.lower() if len(text.lower()) == len(text) else text
        elif c < 0.15:
            text = text.upper() if len(text.upper()) == len(text) else text
        return text, marks


def labelled(size: int = 7000, seed: int = 11, part: int | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, mentions (start, end, kind)) rows; over a third are plain. ``part``: one half of the lists, or all."""
    m = Maker(seed, part)
    return [m.row() for _ in range(size)]
