"""The small labelled table that the field is trained from when no other is given.

Each line is a text in which ``{kind ...}`` marks a span.  ``#`` stands for a digit and ``NAME``, ``HOST``, ``WORD`` and
``TLD`` for words, all drawn by rule; the rest stands as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "text string, spans array<struct<kind:string,start:int,end:int>>"

_WORDS = {
    "NAME": "anna bob john.smith maria peter_k Lee doe jane info sales support Max olga tim k.brown ivan team office luc".split(),
    "HOST": "example mail shop acme host firma uni-bonn correo mysite inbox company web".split(),
    "WORD": "the order and we today house with please storm under river found it when market or light said then only write London Herr Peter Why".split(),
    "TLD": "com org net de fr es edu io info".split(),
}

LINES = r"""
call {phone (###) ###-####} for the WORD
please ring {phone ###-###-####} after noon
WORD WORD tel {phone ### ### ####} or write
phone: {phone ###.###.####}
my number is {phone ##########} thanks
reach us under {phone (0##) #### ####} today
fax {phone ###-####-####} WORD
mobile {phone 0### ######} is best
Telefon {phone 030 #######} WORD
Tel. {phone 0##/#######} WORD
tel: {phone 0### - ### ####}
Telefon: {phone 0###-#######} oder WORD
tél {phone 0# ## ## ## ##} WORD
téléphone {phone 0#.##.##.##.##} merci
teléfono {phone ### ### ###} por favor
llame al {phone ### ## ## ##} WORD
WORD cell {phone ###-####-###} WORD
mobil: {phone 0### - ######}, WORD
handy {phone 0#### ########} Frau NAME
Tel {phone 0### ########} Monday
WORD: {phone 0##### - #####}
WORD {phone 0# ## ## ## ##} WORD
no. {phone 0# ## ## ## ##} jusqu
whatsapp {phone 0## ### ## ##}
you can call me on {phone ### ### ####} WORD
dial {phone ###-####} WORD WORD
dial {phone +# (###) ###-####} {card ################} then
dial {phone +# (###) ###-####} {card #### #### #### ####} then
now {phone +# (###) ###-####} and {phone +## ### ### ####} more
with {phone +# (###) ###-####} ## items
then {card ################} {phone +# (###) ###-####} here
send it to {email NAME at HOST dot TLD} soon
mail {email NAME dot NAME at HOST dot TLD} WORD
reach me at {email NAME dot NAME at HOST dot TLD} please
write {email NAME AT HOST DOT TLD}
write {email NAME.NAME AT HOST DOT TLD} WORD
contact {email NAME [at] HOST [dot] TLD} now
contact {email NAME[at]HOST[dot]TLD}
contact {email NAME (at) HOST (dot) TLD}
email me at {email NAME at HOST dot co dot uk} thanks
e-mail: {email NAME(at)HOST.TLD}
{email NAME (at) HOST.TLD} WORD WORD
{email NAME at HOST dot TLD} or {email NAME at HOST dot TLD}
WORD WORD {email NAME at HOST dot TLD} WORD WORD
my address is {email NAME at HOST dot TLD}, WORD
email {email NAME ## at HOST dot TLD} please
the host {ip ##.#.##.#} answered
server at {ip ##.##.##.##:} down
server {ip ##[.]##[.]##[.]##} was WORD
blocked {ip ###[.]##[.]#[.]##}
from {ip ##(.)###(.)##(.)#} WORD
address {ip ## dot ## dot ## dot ##} WORD
the ip {ip ### dot ### dot # dot ##} is WORD
ping {ip ## . ## . ## . ##} WORD
ip {ip ### . ### . # . ###}
paid with {card #### #### #### ####} online
card number {card ################} expired
card {card ####-####-####-####} was used
visa {card #### #### #### ####} and more
amex {card #### ###### #####} WORD
my amex {card ###############} is WORD
amex {card ###############}
visa {card ################} WORD
card {card #### ###### #####} was WORD
card {card ####-######-#####}
credit card {card ###############} WORD
paid by card {card #### ###### #####} WORD WORD
Karte {card #### #### #### ####} WORD
tarjeta {card #### ###### #####}
card no {card ####.####.####.####} WORD
we met at noon and sat at the table
she looked at him at once
WORD WORD at HOST WORD WORD
look at the dot on the map
a dot at the end of the line
the dot com boom of ####
WORD at WORD dot WORD WORD
he was at home at # and at WORD
NAME was at HOST with NAME
NAME at WORD WORD WORD
version #.#.# came out in ####
version ##.#.##.# of the WORD
in the year #### there were ## of them
it cost ###.## in all and ## more
chapter ## section #.# page ###
from #### to #### the price rose by ##.#
order ################ shipped at last
order no ######## of #### has ## items
order ###-#######-####### is WORD
id ##########-#### was void
isbn ###-#-##-######-# WORD
token = "a#f#e##b#c#d###e#f#a##"
password=e#b#ed#cc#ed# was set
key c#d#e#f#a#b# expired
http://example.com/a/##/b?c=###
see item ##, item ## and item ###
at ## o'clock on ##/##/####
on ####-##-## at ##:##
on ####-##-## ##:##:## the WORD
## percent of ### were at home
copyright (c) #### by the author
line ###: error at ####
room ###, floor ##, at the end
the score was ## to ## at the half
und ## von ### waren im jahr #### dort
en #### il y avait ## personnes et ### autres
en el ### de #### había ## casas
a@b or @name and #### at
p. ###-### and pp. ##-##
total ##,###,### at ##%
WORD ########## ############### WORD
############## ############### ######
### ### WORD ## WORD
##.## ##.## ##.## ##.##
sum ### ## ### ## WORD
WORD, WORD. WORD! WORD? WORD
| WORD | ### | WORD |
WORD *** WORD ### WORD %%% WORD
"""


def expanded(lines: str, draws: int = 6, seed: int = 12345) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) of each line, several draws of each."""
    out, state = [], seed

    def pick(n: int) -> int:
        nonlocal state
        state = (state * 1103515245 + 12345) % 2**31
        return (state >> 16) % n

    for line in lines.strip().split("\n"):
        for _ in range(draws):
            text, spans = "", []
            for kind, inner, outer in re.findall(r"\{(\w+) ([^}]*)\}|([^{]+)", line):
                start = len(text)
                for piece in re.findall(r"#|NAME|HOST|WORD|TLD|.", inner or outer):
                    text += str(1 + pick(9)) if piece == "#" else _WORDS[piece][pick(len(_WORDS[piece]))] if piece in _WORDS else piece
                if kind:
                    spans.append((kind, start, len(text)))
            out.append((text, spans))
    return out


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(expanded(LINES), SCHEMA)
