"""Fixed values of the resume rules: verbs, openers, degrees, headings, link suffixes."""

ACTION_VERBS = (
    "achieved added analysed analyzed architected automated built centralised centralized consolidated converted "
    "coordinated created cut debugged decreased delivered deployed designed developed diagnosed doubled drove "
    "eliminated engineered established expanded extended fixed founded generated grew halved implemented improved "
    "increased initiated integrated introduced launched led maintained managed mentored migrated modelled modeled "
    "modernised modernized negotiated onboarded optimised optimized orchestrated organised organized owned partnered "
    "ported presented prototyped published ran rearchitected rebuilt reduced refactored released removed replaced "
    "researched resolved restructured revamped rewrote rolled saved scaled secured shipped simplified solved sped "
    "standardised standardized streamlined supported taught tested tracked trained tripled unified upgraded won wrote"
).split(" ")

# Openers that say someone was near the work, and verbs that fit better.
WEAK_OPENERS = [
    (r"(?i)^(was |were )?responsible for\b", "Owned, Ran or Led"),
    (r"(?i)^(i )?worked (on|with|in)\b", "Built, Shipped or Developed"),
    (r"(?i)^(i )?(helped|assisted)( in| with| to)?\b", "the part you did yourself — Built, Wrote, Fixed"),
    (r"(?i)^(was )?involved in\b", "what you did — Built, Designed, Tested"),
    (r"(?i)^(i )?participated in\b", "Contributed to, or what you did"),
    (r"(?i)^(i )?handled\b", "Managed, Resolved or Ran"),
    (r"(?i)^(was )?part of\b", "what you did in the team"),
    (r"(?i)^(was )?tasked with\b", "the verb for the task itself"),
    (r"(?i)^duties (included|include)\b", "one bullet per result, each starting with a verb"),
    (r"(?i)^(i )?did\b", "a specific verb — Built, Ran, Wrote"),
    (r"(?i)^(i )?(learned|learnt)\b", "what you built with it"),
]
NUMBER = r"(?i)\d|\b(?:half|double|doubled|tripled|twice)\b"

# Title words that do not make it a different job.
TITLE_FILLER = (
    "a an and the of for in at to with i ii iii iv sr jr senior junior lead staff principal associate - – / & "
    "remote india hybrid"
).split(" ")

# Qualifications, lowest first: pattern, level, rank.
DEGREES = [
    (
        r"(?i)\b(class 12|class xii|12th|higher secondary|senior secondary|hsc|puc|intermediate|cbse|icse)\b",
        "HIGH_SCHOOL",
        0,
    ),
    (r"(?i)\b(diploma|polytechnic)\b", "DIPLOMA", 1),
    (
        r"(?i)\b(b\.?\s?tech|b\.?\s?e\b|bachelor(?:'s)?|b\.?\s?sc|b\.?\s?c\.?a|b\.?\s?com|b\.?\s?a\b|bs\b)",
        "BACHELORS",
        2,
    ),
    (
        r"(?i)\b(m\.?\s?tech|m\.?\s?e\b|master(?:'s)?|m\.?\s?sc|m\.?\s?c\.?a|m\.?\s?com|mba|pgdm|ms\b)",
        "MASTERS",
        3,
    ),
    (r"(?i)\b(ph\.?\s?d|doctorate|doctoral)\b", "DOCTORATE", 4),
]
INSTITUTION = (
    r"(?i)\b(?:indian institute of [a-z ]+|iiit[a-z ]*|iit[a-z ]*|nit [a-z ]+|bits [a-z ]+|"
    r"[a-z.& ]{2,40}(?:university|college|institute of technology)|university of [a-z ]+)\b"
)

NOT_A_NAME = (
    r"(?i)\b(resume|curriculum|vitae|profile|summary|objective|contact|address|phone|email|mobile|linkedin|github|"
    r"experience|education|skills|projects|portfolio|engineer|developer|manager|designer|analyst|scientist|architect|"
    r"consultant|intern)\b"
)
SECTION_HEADING = (
    r"(?i)^\s*(summary|objective|profile|about|experience|work experience|professional experience|employment|"
    r"education|skills|technical skills|projects|certifications|achievements|awards|publications)\s*:?\s*$"
)
TITLE_LINE = (
    r"(?i)^[A-Za-z][A-Za-z0-9+/&.,'-]*(?:\s+[A-Za-z0-9+/&.,'()-]+){0,5}\s*(engineer|developer|programmer|architect|"
    r"designer|manager|analyst|scientist|consultant|administrator|specialist|lead|intern)\b"
)
EXPERIENCE_HEADING = r"(?im)^\s*(work\s+|professional\s+|employment\s+)?(experience|history|employment)\s*:?\s*$"
NEXT_HEADING = (
    r"(?im)^\s*(education|academic|skills|technical skills|projects|certifications|awards|publications|interests|"
    r"languages)\s*:?\s*$"
)
ROLE_WORD = (
    r"(?i)\b(engineer|developer|programmer|architect|designer|manager|analyst|scientist|consultant|administrator|"
    r"specialist|lead|intern|associate|executive|officer|head|director|trainee|tester|devops|sde|founder|co-founder)\b"
)

# Headings by section; a line is one only when it is nothing else.
HEADINGS = [
    ("summary", r"^(professional |career |profile )?(summary|objective|profile|about( me)?|career objective)$"),
    (
        "experience",
        r"^(work |professional |relevant |employment |industry )?"
        r"(experience|history|employment( history)?|internships?|work history)$",
    ),
    ("projects", r"^(academic |personal |key |selected |notable )?projects?$"),
    (
        "education",
        r"^(education(al)?( qualifications?| details| background)?|academic (details|qualifications?|background)|"
        r"qualifications?)$",
    ),
    (
        "skills",
        r"^(technical |key |core |professional )?(skills|competencies|technologies|tech stack|"
        r"tools( and technologies)?|skills (and|&) (tools|technologies))$",
    ),
    (
        "certifications",
        r"^(certifications?|certificates?|licenses?( (and|&) certifications)?|courses|"
        r"certifications? (and|&) courses|training)$",
    ),
    (
        "other",
        r"^(achievements|awards|honou?rs|publications|interests|hobbies|languages( known)?|"
        r"extra[- ]curricular( activities)?|positions of responsibility|volunteering|declaration|"
        r"personal (details|information)|references)$",
    ),
]
BULLET = r"^\s*(?:[•●▪◦‣∙○■□➢➤►*]|-\s|–\s|\d{1,2}[.)]\s)\s*"

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
POINT = (
    rf"\b(?:{_MONTH}\s*'?\s*(?:19|20)?\d{{2}}|(?:0?[1-9]|1[0-2])\s*[/.-]\s*(?:19|20)\d{{2}}|(?:19|20)\d{{2}})\b"
)
NAMED_MONTH = rf"(?i)^({_MONTH})\s*'?\s*((?:19|20)?\d{{2}})$"
OPEN_END = r"(?:present|current(?:ly)?|now|till date|to date|ongoing)"
DATE_RANGE = rf"(?i)\(?\s*({POINT})\s*(?:-|–|—|to|till)\s*({POINT}|{OPEN_END})\s*\)?"
LONE_DATE = rf"(?i)^\(?\s*({POINT})\s*\)?$"

# Link suffixes taken for real, names that only look like links, and hosts that are nobody's own site.
TLDS = (
    "com net org io dev me co in app ai edu gov info xyz tech site online store studio design digital agency "
    "solutions works live life world today news blog wiki link one pro name biz tv cc gg sh to ly is am fm "
    "cloud page space us uk ca de fr au nl se no fi dk es it ch jp cn br mx ru pl pt gr ie nz sg hk kr tw za ae"
).split(" ")
NOT_A_DOMAIN = ["asp.net", "vb.net", "ado.net", "socket.io", "ejs.co"]
KNOWN_HOST = (
    r"(^|\.)(gmail\.com|googlemail\.com|yahoo\.[a-z.]+|outlook\.com|hotmail\.com|protonmail\.com|icloud\.com|"
    r"example\.com|w3\.org|adobe\.com|linkedin\.com|github\.com|credly\.com|youracclaim\.com|coursera\.org|udemy\.com|"
    r"edx\.org|leetcode\.com|hackerrank\.com|codechef\.com|geeksforgeeks\.org|stackoverflow\.com|w3schools\.com|"
    r"microsoft\.com|google\.com|amazon\.com|aws\.amazon\.com|oracle\.com)$"
)
