"""Word lists and tables that results depend on."""

# fmt: off
STOP_WORDS = (
    "the and or but in on at to for of with by from up about into through during before after above below between "
    "among is are was were be been being have has had do does did will would could should may might must can this "
    "that these those a an as if when where why how what who which whose "
    "ca tu hi vai iti eva api atha tatha yatha tena saha cha va na sa te me tvam aham mama tava asya tasya etasya"
).split()
EMPHATIC = {
    *("very really so quite extremely absolutely totally completely definitely hare krishna rama om amen hallelujah "
      "praise glory holy yes no please thank thanks sorry wow oh ah").split(), "hare krishna", "thank you",
}
FILLERS = set(
    "um uh er ah eh hmm mm like you know i mean well so and but the a an is are was were have has had will would could "
    "should can may might must".split()
)
BOGUS = [
    "osho", "www.osho.com", "copyright", "© osho", "transcribed by", "subtitles by", "captions by", "www.", ".com",
    ".org", ".net", "thank you for watching", "subscribe", "like and subscribe", "bell icon",
]
SILENCE_WORDS = "krishna arjuna dharma karma yoga gita bhagavad prabhu swami guru ashram mantra".split()
DISPLAY = [("–", "-"), ("—", "-"), ("…", "..."), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("°", "deg"), ("±", "+/-"), ("×", "x"), ("÷", "/")]
INCOMPLETE = [
    r"\b(and|but|or|so|because|since|when|where|while|if|unless|although)\s*$", r"\b(the|a|an)\s*$",
    r"\b(is|are|was|were|will|would|could|should|might|may)\s*$", r"\b(to|for|with|by|from|in|on|at|of)\s*$",
    r"\b(very|really|quite|rather|somewhat|extremely)\s*$",
]
SUBJECTS = set("i you he she it we they this that these those there".split())
PREDICATES = set("is are was were am be been being have has had do does did will would can could should might may must shall".split())
CONTINUERS = set("and but or so because since when".split())
COMPLETE_PHRASES = ["thank you", "excuse me", "i see", "oh no", "of course", "not yet", "right now", "over there", "come on"]
CANONICAL = {
    "krishna": "Krishna", "krsna": "Krishna", "krisna": "Krishna", "arjuna": "Arjuna", "arjun": "Arjuna",
    "prabhupada": "Prabhupada", "prabhupad": "Prabhupada", "bhagavad": "Bhagavad", "bhagwad": "Bhagavad", "gita": "Gita",
    "geeta": "Gita", "srimad": "Srimad", "shrimad": "Srimad", "bhagavatam": "Bhagavatam", "bhagwatam": "Bhagavatam",
    "dharma": "dharma", "dharm": "dharma", "karma": "karma", "karm": "karma", "bhakti": "bhakti", "bhakty": "bhakti",
    "yoga": "yoga", "yog": "yoga", "moksha": "moksha", "moksh": "moksha", "samsara": "samsara", "samsar": "samsara",
    "mantra": "mantra", "mantr": "mantra", "kirtan": "kirtan", "kirtana": "kirtan", "prasadam": "prasadam",
    "prasad": "prasadam", "devotee": "devotee", "devote": "devotee", "devotees": "devotees", "temple": "temple",
    "templ": "temple", "deity": "deity", "diety": "deity", "vrindavan": "Vrindavan", "vrindaban": "Vrindavan",
    "vrndavan": "Vrindavan", "mayapur": "Mayapur", "mayapura": "Mayapur", "iskcon": "ISKCON", "iskon": "ISKCON",
    "vedic": "Vedic", "vaidic": "Vedic", "sanskrit": "Sanskrit", "sanskrt": "Sanskrit", "guru": "guru", "gur": "guru",
    "consciousness": "consciousness", "consciousnes": "consciousness", "transcendental": "transcendental",
    "transcendentl": "transcendental", "spiritual": "spiritual", "spiritul": "spiritual", "meditation": "meditation",
    "meditaton": "meditation", "chanting": "chanting", "chantng": "chanting", "philosophy": "philosophy",
    "philosphy": "philosophy", "scripture": "scripture", "scriptur": "scripture", "verse": "verse", "vers": "verse",
}
#: Words that the filter replaces, as whole words in any case.
PROFANITY = (
    "fuck fucking fucked fucker fucks shit shitting shitted shits bitch bitching bitches damn damned damning hell hells "
    "ass asses asshole assholes crap crappy craps piss pissed pissing bastard bastards whore whores slut sluts "
    "f*ck f**k f*** fck fuk sh*t sh** sht b*tch b**ch btch d*mn d**n dmn h*ll h**l hll a*s a** azz cr*p cr** p*ss p**s "
    "f4ck sh1t b1tch d4mn h3ll fvck shyt bytch dayum"
).split()
#: Spellings with digits and signs, and what they become.
LEET = [("f[u4@]ck", "f***"), ("sh[i1!]t", "s***"), ("b[i1!]tch", "b****"), ("d[a@4]mn", "d***"), ("h[e3]ll", "h***"), ("[a@4]ss", "a**")]
#: Two of these in a text make its context religious; then RELIGIOUS_KEPT stays.
RELIGIOUS = (
    "krishna rama vishnu shiva brahma hare mantra bhakti yoga dharma karma samsara moksha guru swami temple deity prasadam "
    "kirtan bhajan god lord divine sacred holy prayer worship faith spirit soul heaven paradise blessed grace "
    "hell damn jesus christ allah"
).split()
RELIGIOUS_KEPT = {"hell", "damn"}
SYNONYMS = {
    "fuck": "darn", "shit": "crud", "damn": "darn", "bitch": "person", "hell": "heck", "ass": "butt", "stupid": "silly",
    "idiot": "person", "hate": "dislike",
}
#: Misheard terms in the order in which they are rewritten.
MISHEARD = {
    "diana": "dhyāna", "dianna": "dhyāna", "dhana": "dhyāna", "dyana": "dhyāna", "dhyan": "dhyāna", "kusha": "kuśa",
    "kusa": "kuśa", "kosha": "kuśa", "abhyasa": "abhyāsa", "abhiasa": "abhyāsa", "abhyassa": "abhyāsa",
    "vairagya": "vairāgya", "vairaga": "vairāgya", "pratyahara": "pratyāhāra", "pratyaahara": "pratyāhāra",
    "pratiahara": "pratyāhāra", "pranayama": "prāṇāyāma", "pranayaama": "prāṇāyāma", "pranaayama": "prāṇāyāma",
    "asana": "āsana", "aasana": "āsana", "aasanna": "āsana", "dhaarana": "dhāraṇā", "dharana": "dhāraṇā",
    "dhaaranaa": "dhāraṇā", "samadhi": "samādhi", "samaadhi": "samādhi", "samaadhii": "samādhi", "krishna": "Krishna",
    "krsna": "Krsna", "krisna": "Krishna", "arjuna": "Arjuna", "arjun": "Arjuna", "arjunaa": "Arjuna",
    "bhagavad": "Bhagavad", "bhagavat": "Bhagavad", "bhagwad": "Bhagavad", "prabhupaada": "Prabhupāda",
    "prabhupada": "Prabhupāda", "prabhupad": "Prabhupāda", "madhusudana": "Madhusūdana", "madhusudan": "Madhusūdana",
    "janardana": "Janārdana", "janardan": "Janārdana", "govinda": "Govinda", "govind": "Govinda", "keshava": "Keśava",
    "keshav": "Keśava", "kesava": "Keśava", "atma": "ātmā", "aatma": "ātmā", "aatmaa": "ātmā", "paramatma": "paramātmā",
    "paramaatma": "paramātmā", "paramaatmaa": "paramātmā", "moksha": "mokṣa", "moksh": "mokṣa", "mokshaa": "mokṣa",
    "samsara": "samsāra", "samsaar": "samsāra", "samsaara": "samsāra", "brahmacaari": "brahmacārī",
    "brahmachari": "brahmacārī", "brahmacari": "brahmacārī", "varnasrama": "varṇāśrama", "varnashrama": "varṇāśrama",
    "varna ashrama": "varṇāśrama",
}
DIACRITICS = "āīūṛṝḷḹēōṃḥṅñṭḍṇśṣḻĀĪŪṚṜḶḸĒŌṂḤṄÑṬḌṆŚṢḺ"
KNOWN_TERMS = (
    "Krishna Krsna Arjuna Bhagavan Bhagavad dharma karma yoga Kurukshetra Pandava Kauravas Sanjaya Dhritarashtra Duryodhana "
    "Bhima Yudhishthira Nakula Sahadeva Draupadi Drona Bhishma moksha samsara atman Brahman Paramatma jiva maya lila "
    "bhakti jnana vairagya tapas yajna mantra ashrama varna guru shishya sadhu sant rishi muni acharya "
    "pranayama asana dhyana samadhi pratyahara dharana Vishnu Shiva Brahma Devi Lakshmi Saraswati Ganga "
    "puja aarti prasadam kirtan bhajan satsang darshan vrindavan mathura dvaraka mayapur kashi vraja "
    "Govinda Madhusudana Janardana Vasudeva Keshava Hrishikesha Achyuta Ananta Garuda Hanuman Ganesha Indra Varuna "
    "Agni Vayu Surya Chandra Prithvi Akasha Kala Maha Prabhu Dasa Mata Pitamaha"
).split()
SUFFIXES = "a am an as i u ya va na ra la ta da ma sa".split()
TOPIC_WORDS = "krishna arjuna dharma karma".split()
KEY_WORDS = [*TOPIC_WORDS, "yoga", "soul", "supreme"]
GLOSSARY_TERMS = [
    "Krishna", "Bhagavad Gita", "Srimad Bhagavatam", "Prabhupada", "ISKCON", "devotee", "devotees", "bhakti", "yoga",
    "dharma", "karma", "moksha", "samsara", "guru", "mantra", "kirtan", "prasadam", "temple", "deity", "Radha", "Govinda",
    "Vrindavan", "Mayapur", "spiritual", "consciousness", "transcendental", "meditation", "chanting", "Hare Krishna",
    "maha-mantra", "Vedic", "Sanskrit", "philosophy", "scripture", "verse",
]
FALLBACK_TERMS = ["Krishna", "Arjuna", "Bhagavad Gita", "dharma", "karma", "yoga"]
#: Blue, green, red of each language's captions; any other language is white.
COLOURS = {
    "en": (255, 255, 255), "fr": (255, 180, 120), "de": (0, 255, 255), "it": (0, 165, 255), "hu": (0, 255, 0),
    "ru": (203, 192, 255), "uk": (255, 0, 255),
}
#: Devanagari letters in the international transliteration.
VOWELS = dict(zip("अआइईउऊऋॠऌएऐओऔ", "a ā i ī u ū ṛ ṝ ḷ e ai o au".split(), strict=True))
VOWEL_SIGNS = dict(zip("ािीुूृॄॢेैोौ", "ā i ī u ū ṛ ṝ ḷ e ai o au".split(), strict=True))
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", (
    "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ"
).split(), strict=True))
SIGNS = dict(zip("ंःँऽॐ।॥०१२३४५६७८९", "ṃ ḥ m̐ ' oṃ . .. 0 1 2 3 4 5 6 7 8 9".split(), strict=True))
VIRAMA = "्"
MILD = set("stupid idiot moron dumb dumbass crazy insane nuts mental suck sucks sucked sucking hate hated hating hates".split())
# fmt: on
