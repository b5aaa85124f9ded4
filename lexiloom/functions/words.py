"""Word lists of the lexicon, the style notes and the repairs: fixed values, as text.

An entry is a word, or a word and its readings after a colon. Order and repeats matter: they rank readings.
"""

from __future__ import annotations

# Determiners, with the numbers they take (s, p).
DETERMINERS = """
a:s an:s another:s each:s every:s this:s that:s these:p those:p both:p many:p several:p few:p the:sp its:sp my:sp your:sp his:sp her:sp our:sp
their:sp some:sp any:sp no:sp all:sp most:sp each:s every:s either:s neither:s another:s one:s two:p three:p four:p five:p six:p seven:p eight:p
nine:p ten:p enough:sp such:sp whatever:sp whichever:sp
"""

# Pronouns, with person, number and case (s subject, o object, e either).
PRONOUNS = """
i:1ss me:1so we:1ps us:1po you:2se he:3ss she:3ss it:3se him:3so them:3po they:3ps who:3ss who:3ps everyone:3se everybody:3se someone:3se somebody:3se
anyone:3se nobody:3se something:3se nothing:3se anything:3se everything:3se anybody:3se none:3se there:3ss there:3ps this:3se that:3se these:3pe
those:3pe one:3se ones:3pe others:3pe itself:3so themselves:3po myself:1so yourself:2so himself:3so herself:3so ourselves:1po each:3se either:3se
neither:3se enough:3se all:3pe some:3pe any:3se most:3pe both:3pe many:3pe few:3pe several:3pe another:3se such:3se whatever:3se whichever:3se no:3se
each:3se either:3se neither:3se this:3se that:3se these:3pe those:3pe what:3se
"""

# Verbs that no ending reveals, with their forms.
IRREGULAR_VERBS = """
broke:past spoke:past chose:past froze:past stole:past drove:past rose:past arose:past threw:past grew:past blew:past drew:past flew:past began:past
rang:past sang:past sank:past swam:past became:past forgave:past fell:past held:past+part left:past+part felt:past+part kept:past+part meant:past+part
met:past+part paid:past+part sat:past+part sent:past+part spent:past+part stood:past+part understood:past+part won:past+part lost:past+part
taught:past+part caught:past+part brought:past+part sought:past+part bought:past+part fought:past+part told:past+part sold:past+part bound:past+part
wound:past+part led:past+part fed:past+part bled:past+part laid:past+part heard:past+part built:past+part dealt:past+part slept:past+part
swept:past+part wept:past+part crept:past+part lent:past+part bent:past+part rode:past hid:past bit:past hit:base+past+part let:base+past+part
set:base+past+part cut:base+past+part cost:base+past+part shut:base+past+part split:base+past+part spread:base+past+part read:base+past+part
fit:base+past+part quit:base+past+part broken:part spoken:part chosen:part frozen:part stolen:part driven:part risen:part arisen:part thrown:part
grown:part blown:part drawn:part flown:part begun:part rung:part sung:part sunk:part swum:part become:part forgiven:part fallen:part shown:part
worn:part torn:part sworn:part born:part hidden:part bitten:part ridden:part forgotten:part gotten:part proven:part be:base am:base is:third are:base
was:pasts were:pastp been:part being:ger have:base has:third had:past+part having:ger do:base does:third did:past done:part doing:ger go:base
goes:third went:past gone:part say:base says:third said:past+part make:base makes:third made:past+part take:base takes:third took:past taken:part
come:base+part comes:third came:past see:base sees:third saw:past seen:part know:base knows:third knew:past known:part give:base gives:third gave:past
given:part find:base finds:third found:past+part think:base thinks:third thought:past+part write:base writes:third wrote:past written:part
run:base+part runs:third ran:past eat:base eats:third ate:past eaten:part get:base gets:third got:past+part put:base+past+part puts:third
ought:base+third 's:third 're:base 've:base 'm:base 'd:past lie:base lies:third lay:base+past lain:part
"""

# Nouns that no ending reveals, with their number.
IRREGULAR_NOUNS = """
one:s two:p three:p four:p five:p six:p seven:p eight:p nine:p ten:p man:s men:p woman:s women:p child:s children:p person:s people:p foot:s feet:p
tooth:s teeth:p mouse:s mice:p goose:s geese:p datum:s criterion:s criteria:p analysis:s analyses:p
"""

# Singular nouns that end in s.
SINGULAR_S_NOUNS = """
gas bias lens status basis crisis axis thesis virus census campus radius surplus corpus consensus bonus atlas canvas chaos iris tennis glass loss
success excess illness emphasis apparatus
"""

# Nouns spelt alike in both numbers.
INVARIANT_NOUNS = """
sheep fish deer series species aircraft means offspring data
"""

# Modals.
MODALS = """
cannot can could may might shall should will would must 'll wo ca sha do does did
"""

# Prepositions.
PREPOSITIONS = """
per via versus amid atop amongst beforehand as about above across after against along among around at before behind below beneath beside between
beyond by despite down during except for from in inside into like near of off on onto outside over past since through throughout toward towards under
until up upon with within without
"""

# Coordinators, with what they join to.
COORDINATORS = """
and:sum or:choice but:choice nor:choice yet:choice so:choice
"""

# Subordinators.
SUBORDINATORS = """
although because before if once since though unless until when whenever where whereas wherever while whether that than as so why how unlike which what
whom whose whichever whatever whoever after wherein whereby lest albeit
"""

# Adverbs that no suffix reveals.
BARE_ADVERBS = """
above below abroad afterwards else not never always often sometimes rarely seldom very quite too also just only still already soon now then here
everywhere somewhere anywhere nowhere elsewhere there well almost even rather perhaps however therefore thus instead again ever together apart aside
alike alone ahead away onward onwards forward forwards backwards upwards downwards inwards outwards elsewhere otherwise meanwhile likewise besides
indeed hence nevertheless nonetheless moreover altogether anyway once twice n't
"""

# Verbs that take a to-infinitive.
TAKES_INFINITIVE = """
want wants wanted need needs needed try tries tried hope hopes hoped plan plans planned decide decides decided like likes liked love loves loved begin
begins began start starts started continue continues continued seem seems seemed appear appears appeared refuse refuses refused agree agrees agreed
learn learns learned expect expects expected intend intends intended manage manages managed offer offers offered promise promises promised ought used
failed fails fail
"""

# Adjectives that no suffix reveals.
BARE_ADJECTIVES = """
good bad big small large little long short high low old new young great own same different important able sure clear hard easy early late hot cold
warm cool fast slow quick red green blue black white brown grey gray wet dry full empty heavy light strong weak loud quiet clean dirty rich poor safe
free true false real main next last first second
"""

# Auxiliaries that are no modals.
AUXILIARIES = """
do does did is are was were has have had ca wo sha
"""

# Qualifiers that change nothing.
FILLERS = """
very really quite rather actually basically literally simply
"""

# Endings of abstract nouns.
ABSTRACT = """
tion sion ment ance ence ity ism ness ology ency ancy ship hood dom
"""

# Words that stand for each other in a repair.
PAIRS = """
a:the an:the this:these that:those every:all is:are was:were has:have does:do man:men woman:women child:children person:people mouse:mice foot:feet
tooth:teeth criterion:criteria analysis:analyses datum:data
"""

# Wasteful phrases, what says the same ("-": nothing does; empty: leave it out), and the flaw.
PHRASES = """
in the not too distant future | soon | roundabout
in today s fast paced world |  | worn
it is important to note that |  | worn
it should be noted that |  | worn
for all intents and purposes |  | worn
at the end of the day |  | worn
in the event that | if | roundabout
due to the fact that | because | roundabout
owing to the fact that | because | roundabout
in spite of the fact that | although | roundabout
despite the fact that | although | roundabout
for the purpose of | - | roundabout
with regard to | - | roundabout
in relation to | - | roundabout
in the process of |  | roundabout
a large number of | many | roundabout
a majority of | most | roundabout
in order to | to | roundabout
at this point in time | now | roundabout
in the near future | soon | roundabout
prior to | before | roundabout
subsequent to | after | roundabout
in the absence of | without | roundabout
has the ability to | can | roundabout
is able to | can | roundabout
make a decision | decide | buried
reach a conclusion | conclude | buried
give consideration to | consider | buried
provide an explanation | explain | buried
carry out an analysis | analyse | buried
take into consideration | consider | buried
place an emphasis on | emphasise | buried
conduct an investigation | investigate | buried
each and every | every | redundant
first and foremost | first | redundant
absolutely essential | essential | redundant
completely eliminate | eliminate | redundant
advance planning | planning | redundant
past history | history | redundant
end result | result | redundant
final outcome | outcome | redundant
basic fundamentals | fundamentals | redundant
close proximity | proximity | redundant
free gift | gift | redundant
added bonus | bonus | redundant
unexpected surprise | surprise | redundant
new innovation | innovation | redundant
various different | various | redundant
rich tapestry | - | worn
game changer | - | worn
deep dive | - | worn
seamlessly integrate | - | worn
robust framework | - | worn
leverage | use | worn
utilise | use | worn
utilize | use | worn
delve | - | worn
myriad | many | worn
plethora | many | worn
paradigm | - | worn
synergy | - | worn
holistic | - | worn
"""
