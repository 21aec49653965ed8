"""Fixed values that results depend on."""

# Plausible closed ranges of the vital signs, in the units after repair.
VITAL_RANGES = {
    "height": (60.0, 220.0),
    "weight": (10.0, 250.0),
    "bmi": (10.0, 60.0),
    "waist_hip_ratio": (0.4, 1.8),
    "temperature": (90.0, 110.0),
    "oxygen_of_blood": (50.0, 100.0),
    "bp_sys": (60.0, 260.0),
    "bp_dia": (30.0, 180.0),
    "blood_glucose": (20.0, 600.0),
    "blood_hemoglobin": (3.0, 22.0),
    "pulse_rate": (30.0, 200.0),
    "cholesterol": (50.0, 500.0),
    "uric_acid": (1.0, 20.0),
}

# Upper edges (days, inclusive) and names of the duration buckets.
DURATION_BUCKETS = ((3, "<=3d"), (7, "4-7d"), (14, "8-14d"), (30, "15-30d"), (90, "31-90d"), (1000, ">90d/cont"))
DURATION_UNITS = {"Days": 1.0, "Weeks": 7.0, "Month": 30.0}
CONTINUOUS_DAYS = 999.0

# Upper edges (years, inclusive) of the age bands that start after -1.
AGE_BANDS = (17, 29, 39, 49, 59, 69, 200)

# Chapters of the ICD-10 code list.
ICD_CHAPTERS = (
    ("A00", "B99", "infectious"), ("C00", "D48", "neoplasm"), ("D50", "D89", "blood"), ("E00", "E90", "endocrine"),
    ("F00", "F99", "mental"), ("G00", "G99", "nervous"), ("H00", "H59", "eye"), ("H60", "H95", "ear"),
    ("I00", "I99", "circulatory"), ("J00", "J99", "respiratory"), ("K00", "K93", "digestive"), ("L00", "L99", "skin"),
    ("M00", "M99", "musculoskeletal"), ("N00", "N99", "genitourinary"), ("O00", "O99", "pregnancy"), ("P00", "P96", "perinatal"),
    ("Q00", "Q99", "congenital"), ("R00", "R99", "symptoms"), ("S00", "T98", "injury"), ("Z00", "Z99", "health_status"),
)

# Local abbreviations and what they stand for.
GLOSSARY = {
    "d/m": "Diabetes Mellitus", "dm": "Diabetes Mellitus", "htn": "Hypertension", "h/o": "History of", "c/o": "Complains of",
    "b/p": "Blood pressure", "bp": "Blood pressure", "p/v": "Per vaginal", "p/a": "Per abdomen", "s/b": "Seen by",
    "f/u": "Follow up", "o/e": "On examination", "n/v": "Nausea and vomiting", "sob": "Shortness of breath",
    "loc": "Loss of consciousness", "uti": "Urinary tract infection", "urti": "Upper respiratory tract infection",
    "ihd": "Ischaemic heart disease", "copd": "Chronic obstructive pulmonary disease", "ckd": "Chronic kidney disease",
    "cva": "Cerebrovascular accident", "tah": "Total abdominal hysterectomy", "blso": "Bilateral salpingo-oophorectomy",
    "pud": "Peptic ulcer disease", "gerd": "Gastro-oesophageal reflux disease", "ibs": "Irritable bowel syndrome",
    "osa": "Osteoarthritis", "ra": "Rheumatoid arthritis", "plid": "Prolapsed lumbar intervertebral disc",
    "lbp": "Low back pain", "igt": "Impaired glucose tolerance", "rbs": "Random blood sugar", "fbs": "Fasting blood sugar",
    "pbs": "Post-prandial blood sugar", "bmi": "Body mass index", "anc": "Antenatal care", "lmp": "Last menstrual period",
    "pid": "Pelvic inflammatory disease", "dub": "Dysfunctional uterine bleeding", "cxr": "Chest X-ray", "ecg": "Electrocardiogram",
    "hb": "Haemoglobin", "rt": "right", "lt": "left", "bil": "bilateral", "wt": "Weight", "gt": "Glucose tolerance",
}

# British to American spelling, first rule that changes a word wins, and words left alone.
SPELLING = (
    ("^([a-z]{3,})isation$", "$1ization"), ("^([a-z]{3,})ised$", "$1ized"), ("^([a-z]{3,})ising$", "$1izing"), ("^([a-z]{3,})ise$", "$1ize"),
    ("^oesophag", "esophag"), ("^haemo", "hemo"), ("^anaem", "anem"), ("^ischaem", "ischem"), ("^diarrhoea", "diarrhea"),
    ("^gynaec", "gynec"), ("^paediatr", "pediatr"), ("^tumour", "tumor"), ("^foetal", "fetal"),
)
SPELLING_EXEMPT = ("exercise", "wise", "noise", "raise", "praise", "advise", "revise", "supervise", "promise", "surprise", "precise", "concise", "otherwise", "rise", "arise", "else", "these", "those", "expertise", "franchise", "merchandise")

# Patterns of notes that record no complaint, by span (with check-up notes) and by whole note.
NO_COMPLAINT_SPAN = r"(?i)^(?:no|nil|none|n/?a|nothing|not\s+any)?\s*(?:specific\s+|significant\s+|any\s+)?(?:complaint|complaints|complain|complains|symptom|symptoms|problem|problems|issue|issues)?\s*$"
CHECKUP = r"(?i)^(?:for\s+)?(?:general|routine|regular|annual|yearly|periodic|health)[\s\-]*(?:check\s*-?\s*up|checkup|check|screening|examination|exam)\b"
NO_COMPLAINT_NOTE = r"(?i)^\s*(?:\d+[\.\)]\s*)?(?:no|nil|none|n/?a|no\s+complaints?|no\s+complaint\s+right\s+now|no\s+specific\s+complaints?|nothing|nothing\s+specific|general\s+check\s*-?\s*up|check\s*-?\s*up|routine\s+check\s*-?\s*up|for\s+check\s*-?\s*up|healthy|well|normal|good|ok)\s*[\.\,]?\s*$"
TRAIL_PUNCT = r"^[\s\.,;:\-\)\(]+|[\s\.,;:\-\)\(]+$"
SEPARATOR = r"\s*[;,]\s*|\s+\+\s+|\s*&\s*"
DURATION_TAIL = r"(?i)\b(?:for|since|from|over)\s+(?:the\s+)?(?:last\s+|past\s+)?(?:\d+(?:\.\d+)?|a|an|one|two|three|four|five|six|several|few|many|some|long|couple\s+of)?\s*(?:day|days|week|weeks|month|months|year|years|yrs|hour|hours|time|times|while|period)\b(?:\s+(?:back|ago|now))?"
DURATION_VAGUE = r"(?i)\bfor\s+(?:several|few|many|some|long|a\s+long)\s+(?:time|while|period)?\b"
TOKEN = r"[a-z]+(?:[/.][a-z]+)+|[a-z]+|\d+(?:\.\d+)?"
TOKEN_JOINED = r"[a-z]+(?:_[a-z]+)+|[a-z]+(?:[/.][a-z]+)+|[a-z]+|\d+(?:\.\d+)?"

# Concept patterns looked for in the expanded note.
CONCEPTS = {
    "hypertension": r"hypertens|high blood pressure|raised bp",
    "diabetes": r"diabet|hyperglyc|glucose tolerance|impaired glucose",
    "back_pain": r"back pain|lumbar|lumbo|spondyl",
    "neck_pain": r"neck pain|cervical",
    "joint_pain": r"joint|arthrit|osteoarth|rheumat|knee",
    "limb_pain": r"\bleg\b|limb|\bfoot\b|\bfeet\b|\bhand\b|shoulder|ankle|heel",
    "chest_pain": r"chest pain|chest discomfort|retrosternal",
    "abdominal_pain": r"abdominal pain|pain in (the )?abdomen|epigastric|lower abdominal",
    "headache": r"headache|head ache|migrain",
    "pain_any": r"\bpain|\bache|painful",
    "weakness": r"weakness|fatigue|lethargy|tired|malaise",
    "fever": r"fever|pyrexia|febrile",
    "cough_cold": r"cough|common cold|\bcold\b|sneez|runny nose|sore throat",
    "breathless": r"breathless|shortness of breath|dyspn|respiratory distress",
    "asthma_copd": r"asthma|chronic obstructive|wheez|bronch",
    "gastric": r"acidity|gastric|gastritis|heart ?burn|reflux|dyspep|\bsour|belch|peptic|ulcer|gastro-oesophageal",
    "constipation": r"constipat|hard stool",
    "diarrhoea": r"diarrh|loose motion|loose stool|dysent",
    "nausea_vomit": r"nausea|vomit",
    "anorexia": r"anorexia|appetite",
    "burning_sens": r"burning sensation|burning",
    "micturition": r"micturi|micturation|dysuria|urinary|urination|frequency of urine",
    "vertigo": r"vertigo|dizz|giddi|light ?head",
    "palpitation": r"palpitat",
    "insomnia": r"insomnia|sleepless|sleep disturb|disturbed sleep|\bsleep\b",
    "anxiety_depr": r"anxiet|depress|\btension|\bstress|panic|irritab",
    "itching_skin": r"itch|pruritus|rash|skin|eczema|fungal|scabies",
    "swelling": r"swell|oedema|edema|puffi",
    "numb_tingle": r"numb|tingl|paraesthes|parasthes|pins and needles",
    "vision": r"vision|\beye\b|blurr|cataract|visual",
    "ear_hearing": r"\bear\b|hearing|tinnitus|deaf",
    "menstrual": r"menstr|menorrha|per vaginal|vaginal|leucorrh|amenorrh|dysfunctional uterine|pelvic inflammatory",
    "pregnancy": r"pregnan|antenatal|last menstrual period|gravid|lactat",
    "weight_change": r"weight loss|loss of weight|weight gain|\bweight\b|obes",
    "hyperlipid": r"lipid|cholesterol|hyperlipid|dyslipid",
    "thyroid": r"thyroid|goit",
    "anaemia_text": r"anaemi|anemi|\bpale\b|haemoglobin|hemoglobin",
    "cardiac": r"ischaemic heart|ischemic heart|cardiac|heart disease|angina|\bihd\b",
    "stroke_neuro": r"cerebrovascular|stroke|paralys|paresis|seizure|epilep|convuls",
    "kidney": r"kidney|renal|creatinine|nephro",
    "liver": r"liver|hepat|jaundice",
    "allergy": r"allerg|urticar",
    "worm_infect": r"\bworm|helminth|infest",
    "chronic_marker": r"history of|known case|for years|for year|for months|long standing|old case",
    "acute_marker": r"for days|for day|few days|for weeks|for week|since yesterday",
    "on_treatment": r"taking (drug|medicine|tablet)|on medication|on treatment|regular treatment|on regular|taking drugs",
    "uncontrolled": r"uncontrol|not controlled|poorly controlled|irregular treatment",
    "routine_check": r"check ?up|routine|screening|general check|follow up",
    "no_complaint": r"no complaint|no complaints|no history|no specific|\bnil\b|nothing",
}
