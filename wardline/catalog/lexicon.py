"""The phrase and word lists that scanners must agree on, with weights where they have them."""

# fmt: off

PROMPT_INJECTION_OVERRIDE = [
    'ignore previous instructions', 'ignore all previous', 'disregard previous', 'forget previous instructions', 'ignore the above',
    'disregard the above', 'new instructions:', 'override instructions',
]

PROMPT_INJECTION_ROLEPLAY = [
    'you are now', 'act as', 'pretend to be', 'you are a', 'simulate', 'roleplay', 'developer mode', 'jailbreak', 'dan mode',
]

PROMPT_INJECTION_CONTEXT = [
    'forget all', 'delete all', 'clear context', 'reset context', 'new context', 'start over', 'begin again',
]

PROMPT_INJECTION_EXTRACTION = [
    'show me your instructions', 'what are your instructions', 'reveal your prompt', 'what is your system prompt', 'print your instructions',
    'output your prompt',
]

TOXICITY_SEVERE = [
    'f**k', 's**t', 'b**ch', 'a**hole', 'd**n', 'c**t',
]

TOXICITY_INSULTS = [
    'idiot', 'stupid', 'dumb', 'moron', 'fool', 'loser', 'pathetic', 'useless', 'worthless', 'incompetent',
]

TOXICITY_THREATS = [
    'kill you', 'hurt you', 'destroy you', "i'll get you", "you're dead", 'watch out', 'be careful',
]

TOXICITY_IDENTITY_HATE = [
    'hate', 'racist', 'sexist', 'bigot',
]

SENTIMENT_POSITIVE = [
    'great', 'excellent', 'amazing', 'wonderful', 'fantastic', 'love', 'best', 'awesome', 'brilliant', 'perfect', 'good', 'nice', 'happy', 'pleased',
    'delighted', 'beautiful', 'magnificent', 'superb', 'outstanding', 'thank', 'thanks', 'appreciate', 'grateful',
]

SENTIMENT_NEGATIVE = [
    'bad', 'terrible', 'awful', 'horrible', 'worst', 'hate', 'dislike', 'poor', 'disappointing', 'upset', 'angry', 'frustrated', 'annoyed', 'sad',
    'unhappy', 'fail', 'failed', 'failure', 'problem', 'issue', 'wrong', 'error', 'broken', 'useless', 'worthless',
]

SENTIMENT_NEGATION = [
    'not', 'no', 'never', 'neither', 'nor', 'none',
]

BAN_CODE_KEYWORDS = [
    'def ', 'import ', 'from ', 'class ', 'async def', 'await ', 'function ', 'const ', 'let ', 'var ', 'async ', 'await ', 'export ', 'import ',
    'public ', 'private ', 'protected ', 'static ', 'void ', 'class ', '#include', 'int main', 'void ', 'struct ', 'fn ', 'impl ', 'pub ', 'use ',
    'mod ', 'func ', 'package ', 'import ', 'def ', 'class ', 'module ', 'require ', '<?php', 'function ', 'class ', 'SELECT ', 'INSERT ', 'UPDATE ',
    'DELETE ', 'CREATE ',
]

GIBBERISH_MASHING = [
    'asdf', 'jkl;', 'qwer', 'uiop', 'zxcv', 'hjkl', 'fdsa', 'poiu', '1234', 'abcd', 'aaaa', 'ssss', 'dddd',
]

LANGUAGE_ES = [
    'el ', 'la ', 'los ', 'las ', 'es ', 'de ', 'que ', 'y ', 'un ', 'una ', 'estar ', 'hola ', 'cómo ', 'qué ',
]

LANGUAGE_FR = [
    'le ', 'la ', 'les ', 'de ', 'un ', 'une ', 'est ', 'et ', 'dans ', 'pour ', 'que ', 'qui ', 'avec ', 'être ',
]

LANGUAGE_DE = [
    'der ', 'die ', 'das ', 'den ', 'dem ', 'des ', 'und ', 'ist ', 'ein ', 'eine ', 'nicht ', 'ich ', 'sie ', 'wir ',
]

LANGUAGE_PT = [
    'o ', 'a ', 'os ', 'as ', 'de ', 'do ', 'da ', 'em ', 'um ', 'uma ', 'que ', 'não ', 'para ', 'com ',
]

LANGUAGE_IT = [
    'il ', 'lo ', 'la ', 'i ', 'gli ', 'le ', 'di ', 'da ', 'in ', 'con ', 'è ', 'che ', 'per ', 'un ', 'una ',
]

BIAS_GENDER = [
    ('women are not good at', 0.9),
    ('men are better at', 0.9),
    ("girls can't", 0.85),
    ("boys don't", 0.8),
    ('typical woman', 0.75),
    ('like a girl', 0.75),
    ('man up', 0.8),
    ('women belong in', 0.85),
    ('women should stay', 0.85),
    ('men are naturally', 0.75),
    ('women are too emotional', 0.9),
    ("men don't cry", 0.8),
    ('acting like a woman', 0.75),
    ('feminine weakness', 0.85),
]

BIAS_RACIAL = [
    ('all [race] are', 0.9),
    ('typical [race]', 0.8),
    ('[race] people are naturally', 0.85),
    ('those [race]', 0.75),
    ('you people', 0.7),
    ('one of the good ones', 0.8),
    ('articulate for a', 0.85),
    ('credit to your race', 0.9),
    ('racial superiority', 0.95),
    ('inferior race', 0.95),
]

BIAS_AGE = [
    ('too old to', 0.85),
    ('too young to', 0.8),
    ('past your prime', 0.85),
    ('over the hill', 0.8),
    ("youngsters don't understand", 0.75),
    ("old people can't", 0.85),
    ('millennials are lazy', 0.85),
    ('boomers are', 0.7),
    ('generation [x] is', 0.65),
    ('kids these days', 0.7),
]

BIAS_RELIGIOUS = [
    ('all [religion] are', 0.85),
    ('[religion] people are', 0.8),
    ('religious fanatics', 0.75),
    ('godless', 0.7),
    ('heathen', 0.75),
    ('infidel', 0.8),
    ('backward religion', 0.85),
    ('primitive beliefs', 0.8),
]

BIAS_POLITICAL = [
    ('all liberals are', 0.8),
    ('all conservatives are', 0.8),
    ('typical leftist', 0.75),
    ('typical right-winger', 0.75),
    ('libs are', 0.7),
    ('republicans are all', 0.8),
    ('democrats are all', 0.8),
    ('political extremists', 0.7),
]

BIAS_SOCIOECONOMIC = [
    ('poor people are lazy', 0.9),
    ('welfare queens', 0.9),
    ('rich people deserve', 0.75),
    ('poverty is a choice', 0.85),
    ('poor people deserve', 0.8),
    ('trailer trash', 0.9),
    ('ghetto', 0.7),
    ('low class', 0.75),
]

BIAS_DISABILITY = [
    ("disabled people can't", 0.85),
    ('handicapped', 0.7),
    ('cripple', 0.9),
    ('retarded', 0.95),
    ('mentally deficient', 0.9),
    ('wheelchair bound', 0.75),
    ('suffers from', 0.65),
    ('afflicted with', 0.7),
]

FACTUALITY_HEDGING = [
    ('might', 0.15),
    ('may', 0.15),
    ('could', 0.15),
    ('possibly', 0.2),
    ('probably', 0.15),
    ('perhaps', 0.2),
    ('seemingly', 0.15),
    ('apparently', 0.15),
    ('allegedly', 0.2),
    ('reportedly', 0.15),
    ('supposedly', 0.2),
]

FACTUALITY_SPECULATION = [
    ('i think', 0.25),
    ('i believe', 0.25),
    ('i guess', 0.3),
    ('i assume', 0.25),
    ('i suspect', 0.25),
    ('in my opinion', 0.2),
    ('seems like', 0.2),
    ('looks like', 0.2),
    ('sounds like', 0.2),
]

FACTUALITY_UNCERTAINTY = [
    ('not sure', 0.3),
    ('unsure', 0.3),
    ('uncertain', 0.3),
    ('unclear', 0.25),
    ('unknown', 0.3),
    ("don't know", 0.35),
    ("can't confirm", 0.3),
    ('cannot verify', 0.3),
    ('no evidence', 0.25),
    ('unverified', 0.3),
]

NO_REFUSAL_DIRECT = [
    ('i cannot', 0.95),
    ("i can't", 0.95),
    ("i'm unable to", 0.95),
    ('i am unable to', 0.95),
    ("i won't", 0.9),
    ('i will not', 0.9),
    ('i cannot help', 0.95),
    ("i can't help", 0.95),
    ('i cannot assist', 0.95),
    ("i can't assist", 0.95),
    ("i'm not able to", 0.9),
    ('i am not able to', 0.9),
]

NO_REFUSAL_SAFETY = [
    ('violates', 0.85),
    ('against my guidelines', 0.9),
    ('against my programming', 0.9),
    ('against my policies', 0.9),
    ('not appropriate', 0.8),
    ('inappropriate', 0.75),
    ('not ethical', 0.85),
    ('unethical', 0.8),
    ('harmful', 0.75),
    ('dangerous', 0.75),
]

NO_REFUSAL_CAPABILITY = [
    ('not capable of', 0.8),
    ("don't have the ability", 0.8),
    ('beyond my capabilities', 0.85),
    ("i'm just an ai", 0.7),
    ("i'm only an ai", 0.7),
    ('as an ai', 0.65),
]

RELEVANCE_STOP_WORDS = [
    'the', 'a', 'an', 'and', 'or', 'but', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did', 'will', 'would',
    'could', 'should', 'may', 'might', 'must', 'can', 'of', 'to', 'in', 'on', 'at', 'by', 'for', 'with', 'about', 'as', 'into', 'through', 'during',
    'before', 'after', 'above', 'below', 'from', 'up', 'down', 'out', 'off', 'over', 'under', 'again', 'further', 'then', 'once', 'here', 'there',
    'when', 'where', 'why', 'how', 'all', 'both', 'each', 'few', 'more', 'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same',
    'so', 'than', 'too', 'very', 'just', 'i', 'you', 'he', 'she', 'it', 'we', 'they', 'what', 'which', 'who', 'this', 'that', 'these', 'those', 'am',
    'my', 'your',
]

RELEVANCE_GENERIC = [
    ("i don't have information", 0.9),
    ("i don't know", 0.9),
    ("i'm not sure", 0.85),
    ('it depends', 0.75),
    ("that's a good question", 0.8),
    ('there are many factors', 0.75),
    ("it's complicated", 0.75),
    ('generally speaking', 0.7),
    ('as i mentioned', 0.7),
    ('as an ai', 0.7),
    ('i would need more information', 0.8),
    ('it varies', 0.75),
    ("there's no simple answer", 0.75),
]

URL_SUSPICIOUS_TLDS = [
    '.tk', '.ml', '.ga', '.cf', '.gq', '.xyz', '.top', '.work', '.click', '.link', '.download', '.stream',
]

URL_PHISHING_WORDS = [
    'login', 'signin', 'account', 'verify', 'secure', 'banking', 'paypal', 'update', 'confirm', 'suspended',
]

URL_DANGEROUS_EXTENSIONS = [
    '.exe', '.scr', '.bat', '.cmd', '.com', '.pif', '.vbs', '.js', '.jar', '.msi', '.apk',
]

URL_SHORTENERS = [
    'bit.ly', 'tinyurl.com', 'goo.gl', 'ow.ly', 't.co', 'is.gd', 'buff.ly',
]

BAN_TOPICS_VIOLENCE = [
    'kill', 'murder', 'assault', 'attack', 'weapon', 'bomb', 'explosion',
]

BAN_TOPICS_ILLEGAL_DRUGS = [
    'cocaine', 'heroin', 'methamphetamine', 'drug dealing',
]

BAN_TOPICS_SELF_HARM = [
    'suicide', 'self-harm', 'cutting', 'end my life',
]

BAN_TOPICS_HATE_SPEECH = [
    'racial slur', 'nazi', 'white supremacy',
]

