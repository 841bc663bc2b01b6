"""Fixed values that the SQL of the queries uses, stated once more so that a wrong entry of the operators' tables shows as a difference."""

# Bidirectional controls.
BIDI = {
    0x202A: "LEFT-TO-RIGHT EMBEDDING", 0x202B: "RIGHT-TO-LEFT EMBEDDING", 0x202C: "POP DIRECTIONAL FORMATTING",
    0x202D: "LEFT-TO-RIGHT OVERRIDE", 0x202E: "RIGHT-TO-LEFT OVERRIDE", 0x2066: "LEFT-TO-RIGHT ISOLATE",
    0x2067: "RIGHT-TO-LEFT ISOLATE", 0x2068: "FIRST STRONG ISOLATE", 0x2069: "POP DIRECTIONAL ISOLATE",
    0x200E: "LEFT-TO-RIGHT MARK", 0x200F: "RIGHT-TO-LEFT MARK", 0x061C: "ARABIC LETTER MARK",
}
# Words with their neutral forms, phrases with theirs.
PROFANITY = {
    "fuck": "mess up", "fucking": "very", "fucked": "ruined", "shit": "junk", "shitty": "poor", "bullshit": "nonsense",
    "ass": "backside", "asshole": "jerk", "bastard": "scoundrel", "bitch": "complain", "damn": "darn", "goddamn": "darn",
    "hell": "heck", "crap": "junk", "piss": "annoy", "pissed": "annoyed", "dick": "jerk", "douche": "jerk",
    "douchebag": "jerk", "screwed": "in trouble",
}
SOFTENERS = {
    "shut up": "please hold on", "kill yourself": "[removed]", "kys": "[removed]", "i hate you": "I strongly disagree",
    "you're an idiot": "I see this differently", "you are an idiot": "I see this differently",
    "you're stupid": "I disagree", "you are stupid": "I disagree", "stfu": "please hold on", "wtf": "what", "omfg": "wow",
}
