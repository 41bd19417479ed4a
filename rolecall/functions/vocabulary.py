"""Word lists and patterns the text rules are defined by.

These are data, listed plainly in their natural order. Patterns are Java regex;
`(?i)` marks the ones that ignore case.
"""

# Indian cities by hiring volume: spelling pattern -> display name.
CITIES = [
    ("bengaluru|bangalore", "Bengaluru"),
    ("hyderabad", "Hyderabad"),
    ("pune", "Pune"),
    ("gurugram|gurgaon", "Gurugram"),
    ("noida", "Noida"),
    ("new delhi|delhi", "Delhi"),
    ("mumbai|bombay", "Mumbai"),
    ("chennai|madras", "Chennai"),
    ("kolkata", "Kolkata"),
    ("ahmedabad", "Ahmedabad"),
    ("jaipur", "Jaipur"),
    ("kochi|cochin", "Kochi"),
    ("coimbatore", "Coimbatore"),
    ("indore", "Indore"),
    ("chandigarh", "Chandigarh"),
    ("thiruvananthapuram|trivandrum", "Thiruvananthapuram"),
    ("vadodara|baroda", "Vadodara"),
    ("mysuru|mysore", "Mysuru"),
    ("bhubaneswar", "Bhubaneswar"),
    ("nagpur", "Nagpur"),
    ("visakhapatnam|vizag", "Visakhapatnam"),
    ("mohali", "Mohali"),
    ("lucknow", "Lucknow"),
    ("hosur", "Hosur"),
]
CITY_NAMES = [name for _, name in CITIES]
CITY_WORDS = sorted({w for pattern, _ in CITIES for w in pattern.split("|")})

# Indian states and union territories.
STATES = (
    "andhra pradesh|arunachal pradesh|assam|bihar|chhattisgarh|goa|gujarat|haryana|himachal pradesh|jharkhand|"
    "karnataka|kerala|madhya pradesh|maharashtra|manipur|meghalaya|mizoram|nagaland|odisha|orissa|punjab|"
    "rajasthan|sikkim|tamil nadu|telangana|tripura|uttar pradesh|uttarakhand|west bengal|jammu and kashmir|"
    "ladakh|puducherry"
)

# ------------------------------------------------------------------ discipline

# Titles never listed, whatever else they say.
EXCLUDED_TITLE = (
    r"(?i)\b(sales|account (executive|manager|management)|business development|recruit|talent|marketing|legal|"
    r"counsel|finance|accountant|payroll|customer success|support engineer|technical services? engineer|\bTSE\b|"
    r"solutions? (engineer|architect|consultant)|sales engineer|customer engineer|field engineer|implementation|"
    r"pre-?sales|technical account|partner (manager|marketing|enablement|development)|partnerships|"
    r"operations manager|hr\b|people partner|gtm|go-to-market|client (onboarding|success|partner|director|manager)|"
    r"corporate it|it (support|administrator|helpdesk)|desktop support|copywriter|video editor)"
)

# First rule that matches the title wins.
DISCIPLINE_RULES = [
    (
        r"(?i)\b(security|secops|siem|appsec|infosec|soc analyst|penetration|incident response|"
        r"detection (and|&) response)\b",
        "SECURITY",
    ),
    (
        r"(?i)\b(site reliability|sre|devops|dev ops|infrastructure|platform engineer|cloud engineer|"
        r"network engineer|database (engineer|administrator)|dba|systems engineer|reliability)\b",
        "INFRASTRUCTURE",
    ),
    (
        r"(?i)\b(data (scientist|science|engineer|engineering|analyst|analytics|architect)|analytics|"
        r"machine learning|ml|ml ?ops|ai (engineer|researcher|scientist)|applied (ai|scientist)|"
        r"research (scientist|engineer)|researcher|deep learning|nlp|computer vision)\b",
        "DATA",
    ),
    (r"(?i)\b(designer|design|ux|ui\/ux|user research(er)?|ux research(er)?)\b", "DESIGN"),
    (
        r"(?i)\b(product manager|product management|product owner|product lead|head of product|"
        r"director of product|vp,? product|group product|technical program manager|program manager)\b",
        "PRODUCT",
    ),
    (
        r"(?i)\b(engineer|engineering|developer|software|sde|swe|programmer|architect|qa|sdet|tester|"
        r"test automation|mobile|android|ios|frontend|front-end|backend|back-end|full[- ]?stack)\b",
        "ENGINEERING",
    ),
]

# Engineering outside software, kept only with a software word beside it.
NON_SOFTWARE = (
    r"(?i)\b(mechanical|civil|structural|chemical|piping|hvac|process engineer|manufacturing|production|plant|"
    r"maintenance|welding|tooling|instrumentation|electrical|power systems|field service|installation|"
    r"commissioning|technician|quality (inspector|control|assurance engineer - mech)|supplier quality|procurement|"
    r"sourcing|logistics|warehouse|clinical|medical|pharmacovigilance|regulatory|biostatistic|actuar|underwrit|"
    r"audit|tax|treasury|fund (accounting|controller)|claims)\b"
)
SOFTWARE_HINT = (
    r"(?i)\b(software|firmware|embedded|data|cloud|devops|ai|ml|digital|automation engineer|sde|developer|"
    r"full[- ]?stack|backend|frontend|platform)\b"
)
TECH_DEPARTMENT = r"(?i)engineering|technology|r&d"
GENERIC_TITLE = r"(?i)technical|staff|scientist"

# ------------------------------------------------------------------ employment type and level

EMPLOYMENT_RULES = [
    (r"(?i)\b(intern|interns|internship|trainee|apprentice)\b", "INTERNSHIP"),
    (r"(?i)\b(contract|contractual|contractor|freelance|consultant|c2h)\b", "CONTRACT"),
    (r"(?i)\bpart[\s-]?time\b", "PART_TIME"),
    (r"(?i)\b(temporary|seasonal|fixed[\s-]?term)\b", "TEMPORARY"),
]

# (pattern, pattern that must be absent or None, level), first match wins.
LEVEL_RULES = [
    (r"(?i)\b(intern|internship|trainee|apprentice)\b", None, "INTERN"),
    (r"(?i)\b(director|vp|vice president|head of)\b", None, "DIRECTOR"),
    (r"(?i)\bgroup product manager\b", None, "MANAGER"),
    (r"(?i)\bmanager\b", r"(?i)\bproduct manager\b|program manager", "MANAGER"),
    (r"(?i)\b(principal|distinguished|fellow)\b", None, "PRINCIPAL"),
    (r"(?i)\bstaff\b", None, "STAFF"),
    (r"(?i)\b(senior|sr\.?|lead)\b|\b(sde|swe|engineer|developer)[\s-]*(iii|3)\b", None, "SENIOR"),
    (
        r"(?i)\b(junior|jr\.?|associate|graduate|fresher|entry[- ]level|new grad)\b|"
        r"\b(sde|swe|engineer|developer)[\s-]*(i|1)\b",
        None,
        "JUNIOR",
    ),
]

# ------------------------------------------------------------------ skills

_GO_NEIGHBOURS = r"Java|Python|Rust|Kotlin|C\+\+|Scala|Node(?:\.js)?|TypeScript|Ruby|Elixir"

# Skill vocabulary: (display name, pattern). Mixed case rules are deliberate:
# "Go", "Swift" and "Rust" are also ordinary English words.
SKILLS = [
    (
        "Go",
        rf"\bGolang\b|(?:{_GO_NEIGHBOURS})\s*(?:,|/|or|and)\s*Go\b|\bGo\s*(?:,|/|or|and)\s*(?:{_GO_NEIGHBOURS})",
    ),
    ("Java", r"\bJava\b"),
    ("Spring Boot", r"(?i)\bSpring ?Boot\b"),
    ("Python", r"\bPython\b"),
    ("TypeScript", r"\bTypeScript\b"),
    ("JavaScript", r"\bJavaScript\b"),
    ("React", r"\bReact(?:\.?js)?\b(?! Native)"),
    ("React Native", r"\bReact Native\b"),
    ("Node.js", r"(?i)\bNode(?:\.?js)\b"),
    ("Kotlin", r"\bKotlin\b"),
    ("Swift", r"\bSwift(?:UI)?\b"),
    ("Android", r"\bAndroid\b"),
    ("iOS", r"\biOS\b"),
    ("Flutter", r"\bFlutter\b"),
    ("Rust", r"\bRust\b"),
    ("C++", r"\bC\+\+"),
    ("Scala", r"\bScala\b"),
    ("Kubernetes", r"(?i)\bKubernetes\b|\bK8s\b"),
    ("Docker", r"\bDocker\b"),
    ("Terraform", r"\bTerraform\b"),
    ("AWS", r"\bAWS\b"),
    ("GCP", r"\bGCP\b|Google Cloud"),
    ("Azure", r"\bAzure\b"),
    ("Kafka", r"\bKafka\b"),
    ("PostgreSQL", r"(?i)\bpostgre(?:s|sql)\b"),
    ("MySQL", r"\bMySQL\b"),
    ("MongoDB", r"\bMongoDB\b"),
    ("Redis", r"\bRedis\b"),
    ("Elasticsearch", r"(?i)\bElastic ?search\b"),
    ("Spark", r"\bSpark\b"),
    ("Airflow", r"\bAirflow\b"),
    ("dbt", r"\bdbt\b"),
    ("Snowflake", r"\bSnowflake\b"),
    ("SQL", r"\bSQL\b"),
    ("PyTorch", r"\bPyTorch\b"),
    ("TensorFlow", r"\bTensorFlow\b"),
    ("LLMs", r"(?i)\bLLMs?\b|large language model"),
    ("Microservices", r"(?i)\bmicro-?services\b"),
    ("Distributed systems", r"(?i)\bdistributed systems?\b"),
    ("Figma", r"\bFigma\b"),
    ("Design systems", r"(?i)\bdesign systems?\b"),
    ("Selenium", r"\bSelenium\b"),
    ("GraphQL", r"\bGraphQL\b"),
    ("Angular", r"\bAngular(?:JS)?\b"),
    ("Vue", r"\bVue(?:\.?js)?\b"),
    ("Next.js", r"(?i)\bNext\.?js\b"),
    ("Svelte", r"(?i)\bSvelte(?:Kit)?\b"),
    ("Redux", r"\bRedux\b"),
    ("Tailwind CSS", r"(?i)\bTailwind\b"),
    ("Django", r"\bDjango\b"),
    ("Flask", r"\bFlask\b"),
    ("FastAPI", r"(?i)\bFast ?API\b"),
    ("Express", r"\bExpress(?:\.?js)?\b"),
    ("Hibernate", r"\bHibernate\b"),
    (".NET", r"(?i)\.NET\b|\bdotnet\b"),
    ("C#", r"\bC#"),
    ("PHP", r"(?i)\bPHP\b"),
    ("Laravel", r"\bLaravel\b"),
    ("Ruby on Rails", r"\bRuby on Rails\b|\bRails\b"),
    ("Pandas", r"(?i)\bpandas\b"),
    ("NumPy", r"(?i)\bnum ?py\b"),
    ("scikit-learn", r"(?i)\bscikit[- ]?learn\b|\bsklearn\b"),
    ("Hadoop", r"(?i)\bHadoop\b"),
    ("Hive", r"\bHive\b"),
    ("Flink", r"(?i)\bFlink\b"),
    ("Databricks", r"(?i)\bDatabricks\b"),
    ("Tableau", r"(?i)\bTableau\b"),
    ("Power BI", r"(?i)\bPower ?BI\b"),
    ("BigQuery", r"(?i)\bBig ?Query\b"),
    ("Redshift", r"(?i)\bRedshift\b"),
    ("SQL Server", r"(?i)\bSQL Server\b|\bMSSQL\b"),
    ("SQLite", r"(?i)\bSQLite\b"),
    ("Cassandra", r"(?i)\bCassandra\b"),
    ("DynamoDB", r"(?i)\bDynamo ?DB\b"),
    ("Firebase", r"(?i)\bFirebase\b"),
    ("Jenkins", r"(?i)\bJenkins\b"),
    ("Ansible", r"(?i)\bAnsible\b"),
    ("Grafana", r"(?i)\bGrafana\b"),
    ("Prometheus", r"(?i)\bPrometheus\b"),
    ("Nginx", r"(?i)\bNginx\b"),
    ("GitHub Actions", r"(?i)\bGitHub Actions\b"),
    ("GitLab CI", r"(?i)\bGitLab ?(?:CI|CI\/CD)\b"),
    ("Helm", r"\bHelm\b"),
    ("Argo CD", r"(?i)\bArgo ?CD\b"),
    ("Linux", r"(?i)\bLinux\b"),
    ("Cypress", r"\bCypress\b"),
    ("Playwright", r"(?i)\bPlaywright\b"),
    ("JUnit", r"(?i)\bJUnit\b"),
    ("Jest", r"\bJest\b"),
    ("pytest", r"(?i)\bpy ?test\b"),
    ("Appium", r"(?i)\bAppium\b"),
    ("TestNG", r"(?i)\bTestNG\b"),
    ("RabbitMQ", r"(?i)\bRabbit ?MQ\b"),
    ("gRPC", r"(?i)\bgRPC\b"),
    ("Maven", r"(?i)\bMaven\b"),
    ("Gradle", r"(?i)\bGradle\b"),
    ("Machine learning", r"(?i)\bmachine learning\b"),
    ("NLP", r"(?i)\bNLP\b|\bnatural language processing\b"),
    ("Computer vision", r"(?i)\bcomputer vision\b"),
]

# Lower-case text at least one of which must occur before a pattern is tried
# (a cheap substring test in front of the regex). Default: the name itself.
SKILL_LITERALS = {
    "Go": ["go"],
    "Spring Boot": ["spring"],
    "Node.js": ["nodejs", "node.js"],
    "Kubernetes": ["kubernetes", "k8s"],
    "GCP": ["gcp", "google cloud"],
    "PostgreSQL": ["postgres", "postgresql"],
    "Elasticsearch": ["elastic"],
    "LLMs": ["llm", "large language model"],
    "Microservices": ["services"],
    "Distributed systems": ["distributed system"],
    "Design systems": ["design system"],
    "Next.js": ["next.js", "nextjs"],
    "Tailwind CSS": ["tailwind"],
    "FastAPI": ["fast"],
    ".NET": [".net", "dotnet"],
    "Ruby on Rails": ["rails"],
    "NumPy": ["num"],
    "scikit-learn": ["scikit", "sklearn"],
    "Power BI": ["power"],
    "BigQuery": ["query"],
    "SQL Server": ["sql server", "mssql"],
    "DynamoDB": ["dynamo"],
    "GitLab CI": ["gitlab"],
    "Argo CD": ["argo"],
    "pytest": ["py"],
    "RabbitMQ": ["rabbit"],
    "NLP": ["nlp", "natural language processing"],
}

# ------------------------------------------------------------------ titles

# Words of a title that mean the same when two postings are compared.
DEDUPE_TITLE_WORDS = {"sr": "senior", "snr": "senior", "jr": "junior", "ii": "2", "iii": "3", "iv": "4", "i": "1"}

# Short forms spelled out in suggestions.
SUGGEST_TITLE_WORDS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "mgr": "manager",
    "engg": "engineer", "asst": "assistant", "assoc": "associate",
}
PLACE_WORDS = CITY_NAMES + [
    "Bangalore", "Gurgaon", "Bombay", "New Delhi", "NCR", "India", "Remote", "Hybrid", "Onsite", "On-site", "WFH",
]

# Other names people type for a city; NCR stands for each of its cities.
CITY_ALIASES = {
    "Bengaluru": ["Bangalore", "Bengaluru", "BLR", "Bangaluru"],
    "Hyderabad": ["Secunderabad", "Hyd", "Cyberabad"],
    "Pune": ["Poona"],
    "Gurugram": ["Gurgaon", "GGN", "NCR", "Delhi NCR"],
    "Noida": ["Greater Noida", "NCR", "Delhi NCR"],
    "Delhi": ["New Delhi", "NCR", "Delhi NCR"],
    "Mumbai": ["Bombay", "Navi Mumbai", "Thane"],
    "Chennai": ["Madras"],
    "Kolkata": ["Calcutta"],
    "Kochi": ["Cochin", "Ernakulam"],
    "Thiruvananthapuram": ["Trivandrum", "TVM"],
    "Vadodara": ["Baroda"],
    "Mysuru": ["Mysore"],
    "Visakhapatnam": ["Vizag"],
    "Bhubaneswar": ["Bhubaneshwar"],
}
REMOTE_ALIASES = ["WFH", "Work from home", "Anywhere", "Remote India"]

# HTML entities with a name.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "bull": "•", "middot": "·",
    "rupee": "₹", "euro": "€", "pound": "£",
}

NO_DESCRIPTION = "See the full description on the company's careers page."
