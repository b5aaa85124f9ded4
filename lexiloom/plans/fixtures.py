"""Labelled sentences and passages: fixed values that reports are held against."""

from __future__ import annotations

# Sentences that break no rule.
GOOD = """
the dog runs
the dogs run
she walks to the store
he can walk
they have walked
i am here
you are here
we were here
she was here
the child sees the mice
the children see the mouse
a person writes
several people write
the sheep runs
the sheep run
the key to the cabinets is missing
the keys to the cabinet are missing
the analysis of the data is complete
the criteria are clear
he should have written
she is walking
the data are complete
everyone knows
nobody was here
the men were running
it does not matter
they do not matter
the woman gave the book to him
we think that she is right
because the dog ran, we walked
the teacher of the students was late
the students of the teacher were late
one of the dogs is barking
she has been walking
they had been running
the book on the shelves is old
the books on the shelf are old
he did not know
we have seen the mice
the geese were loud
the goose was loud
she wants to walk
they need to run
he tried to write
the analyses are complete
a criterion is clear
this data is complete
these criteria are clear
the person was here
the people were here
she gives him the book
the aircraft was late
the aircraft were late
the species is rare
the species are rare
he ought to know
we should have known
the woman who was here left
nothing was found
it is here
the fish swims
the fish swim
she walked quickly to the store
the old man was here
we can see the light
the conventions a passage holds to are listed
a word the lexicon cannot place is refused
the reports she writes are short
a tokenised sentence is read once
the chosen reading is cheapest
whatever it still pays for is wrong
the cabinet she took it from is empty
a chorus repeats itself
the analysis of the data is complete
"""

# Sentences that break a rule, and the rule.
BAD = """
a dogs run | DeterminerNumber
these dog runs | DeterminerNumber
the dog run | SubjectVerb
the dogs runs | SubjectVerb
he walk | SubjectVerb
they walks | SubjectVerb
i walks | SubjectVerb
she can walks | ModalTakesBase
he must walked | ModalTakesBase
the children walks | SubjectVerb
the child walk | SubjectVerb
the men was here | SubjectVerb
the man were here | SubjectVerb
i were here | SubjectVerb
the key to the cabinets are missing | SubjectVerb
the keys to the cabinet is missing | SubjectVerb
the analysis of the data are complete | SubjectVerb
she wants to walks | ToTakesBase
the criteria is clear | SubjectVerb
every dogs run | DeterminerNumber
"""

# Wasteful sentences, and the flaw.
WASTEFUL = """
due to the fact that it rained we stayed | roundabout
in order to walk she left | roundabout
each and every dog runs | redundant
the end result was good | redundant
we make a decision | buried
it is important to note that dogs run | worn
we leverage the framework | worn
the very good dog runs | filler
there are three dogs | delayed
the dog walked the dog | echo
at the end of the day dogs run | worn
she has the ability to run | roundabout
"""

# Passages of different kinds; and the conventions each gives up.
PASSAGES = {
    'technical': ('The parser reads the file. It returns a tree. The caller checks the result. A failure raises an error.', ()),
    'story': ('The old man walked to the door. He opened it slowly. A cold wind came in. He did not move.', ()),
    'message': ('hey\nim running late\nthe train dont move\ncant help it\nsee you soon', ('marks', 'apostrophes')),
    'haiku': ('an old pond\na frog jumps in\nthe sound of water', ('predicate',)),
    'lyric': ('i want it i want it\ni need it i need it\ni want it i want it\ni need it i need it', ('fresh',)),
}

# A line that spoils each passage.
SPOILED = {
    'technical': 'The parsers reads the file.',
    'story': 'The old men walks to the door.',
    'message': 'the trains was late',
    'haiku': 'the frogs jumps in',
    'lyric': 'i wants it i wants it',
}

# Padded passages, and what each comes down to.
CONDENSED = (
    ('Like a delicate flower blooming in the digital garden of our enterprise architecture, this method gently whispers to the private field and coaxes it into the light. It is a testament to the beauty of object-oriented design that we must retrieve this number, not because we want to, but because we must. It returns the value, which is an integer, representing the number of items. Truly, a masterpiece of modern engineering.', 'It returns the value, which is an integer, representing the number of items.'),
    ('Crucial Web3 blockchain-enabled AI parser. By invoking this high-performance neural utility, you are initiating a multi-agent decentralized ledger consensus mechanism that securely parses the raw JSON string into a robust dictionary array. Note: Do not use if the moon is in gibbous phase, as quantum decoherence in the garbage collector may cause stack overflow in non-existent local servers. Returns the parsed JSON.', 'Returns the parsed JSON.'),
    ("This function, which does adding, adds two numbers, x and y, or is it y and x, mathematically it doesn't matter, but clean code dictates, we must document this, with extreme precision, to avoid technical debt, and promote synergy, among developer pipelines. Adds x to y.", 'Adds x to y.'),
    ("Calculates the length of the string by measuring how long the string is. To determine the length, it counts the characters, and the total count of these characters represents the string's length. If the string is longer, the length will be larger; if the string is shorter, the length will be smaller. The returned value is the length.", "It counts the characters, and the total count of these characters represents the string's length."),
    ('Deep-dive into a strategic paradigm shift leveraging state-of-the-art Boolean metrics to optimize cross-functional flag alignment. By dynamically auditing the active status indicator, we synergize runtime protocols to return a robust truth value. This empowers stakeholder-driven execution pathways to achieve peak digital transformation.', 'By dynamically auditing the active status indicator, we synergize runtime protocols to return a robust truth value.'),
    ('As an AI language model, I am programmed to write clean documentation. To answer your query about this method: it updates the user profile. I hope this explanation of updating the user database entry helper function is helpful! Let me know if you need any more clean, highly-optimized enterprise-grade Java functions documented today.', 'It updates the user profile.'),
    ('Like the ancient scribes of Alexandria etching truths upon papyrus to withstand the relentless sands of time, this database save function carves your entity into the cold, unyielding SQL disk. It is a sacred ritual. It returns a void, for some truths are too profound to yield a return value.', 'It returns a void, for some truths are too profound to yield a return value.'),
    ("If you managed to break this, I honestly don't know what to tell you. It literally just catches the error that your terrible code probably threw because you don't understand basic asynchronous lifecycle scopes. It logs the error to the console so we can all see exactly where you failed. You're welcome.", 'It logs the error to the console.'),
    ("Normalizes a real-valued scalar quantity by projecting its vector magnitude onto a non-negative one-dimensional Cartesian space. By isolating the coefficient from its negative algebraic operator, we successfully execute a distance-from-zero translation matrix. In layman's terms: it strips the minus sign.", "In layman's terms: it strips the minus sign."),
    ('BEST EMAIL VALIDATOR FOR WEB DEVELOPERS 2026. Fast free lightweight validation regex pattern. Learn how to validate email in javascript tutorial. This function verifies email address string is valid format.', 'This function verifies email address string is valid format.'),
)
# Lines of a file's notes, whether they are repaired or said plainer, and the lines that must come out.
REWRITES = {
    'repair': (('The dog run fast. The cat sleeps here. The birds sings loudly.',), 'repairs', ('The dog runs fast. The cat sleeps here. The birds sing loudly.',)),
    'plain': (('It is important to note that the parser is slow due to the fact that it waits.', 'In order to run it, you must wait at this point in time.'), 'plain', ('The parser is slow because it waits.', 'To run it, you must wait now.')),
    'unknown': (('The zzqx run fast.',), 'repairs', ('The zzqx run fast.',)),
}
