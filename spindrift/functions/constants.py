"""Word lists, patterns, labels and limits that results depend on."""

from __future__ import annotations

# Fixed values. Words that name a country in a query, with its name as it stands in the data.
COUNTRIES = [
    ("united states", "United States"), ("usa", "United States"), ("u.s.a.", "United States"), ("u.s.", "United States"), ("us", "United States"),
    ("america", "United States"), ("american", "United States"),
    ("united kingdom", "United Kingdom"), ("uk", "United Kingdom"), ("britain", "United Kingdom"), ("england", "United Kingdom"),
    ("china", "China"), ("chinese", "China"),
    ("canada", "Canada"), ("canadian", "Canada"),
    ("france", "France"), ("french", "France"),
    ("germany", "Germany"), ("german", "Germany"),
    ("japan", "Japan"), ("japanese", "Japan"),
    ("south korea", "South Korea"), ("korea", "South Korea"), ("korean", "South Korea"),
    ("australia", "Australia"), ("australian", "Australia"),
    ("italy", "Italy"), ("italian", "Italy"),
    ("spain", "Spain"), ("spanish", "Spain"),
    ("netherlands", "Netherlands"), ("dutch", "Netherlands"),
    ("belgium", "Belgium"),
    ("switzerland", "Switzerland"), ("swiss", "Switzerland"),
    ("india", "India"), ("indian", "India"),
    ("brazil", "Brazil"), ("brazilian", "Brazil"),
    ("mexico", "Mexico"), ("mexican", "Mexico"),
    ("turkey", "Turkey (Türkiye)"), ("turkish", "Turkey (Türkiye)"),
]

# Fixed values. Words that name a state, with its name.
STATES = [
    ("alabama", "Alabama"),
    ("alaska", "Alaska"),
    ("arizona", "Arizona"),
    ("arkansas", "Arkansas"),
    ("california", "California"),
    ("colorado", "Colorado"),
    ("connecticut", "Connecticut"),
    ("delaware", "Delaware"),
    ("florida", "Florida"),
    ("georgia", "Georgia"),
    ("hawaii", "Hawaii"),
    ("idaho", "Idaho"),
    ("illinois", "Illinois"),
    ("indiana", "Indiana"),
    ("iowa", "Iowa"),
    ("kansas", "Kansas"),
    ("kentucky", "Kentucky"),
    ("louisiana", "Louisiana"),
    ("maine", "Maine"),
    ("maryland", "Maryland"),
    ("massachusetts", "Massachusetts"),
    ("michigan", "Michigan"),
    ("minnesota", "Minnesota"),
    ("mississippi", "Mississippi"),
    ("missouri", "Missouri"),
    ("montana", "Montana"),
    ("nebraska", "Nebraska"),
    ("nevada", "Nevada"),
    ("new hampshire", "New Hampshire"),
    ("new jersey", "New Jersey"),
    ("new mexico", "New Mexico"),
    ("new york", "New York"),
    ("north carolina", "North Carolina"),
    ("north dakota", "North Dakota"),
    ("ohio", "Ohio"),
    ("oklahoma", "Oklahoma"),
    ("oregon", "Oregon"),
    ("pennsylvania", "Pennsylvania"),
    ("rhode island", "Rhode Island"),
    ("south carolina", "South Carolina"),
    ("south dakota", "South Dakota"),
    ("tennessee", "Tennessee"),
    ("texas", "Texas"),
    ("utah", "Utah"),
    ("vermont", "Vermont"),
    ("virginia", "Virginia"),
    ("washington", "Washington"),
    ("west virginia", "West Virginia"),
    ("wisconsin", "Wisconsin"),
    ("wyoming", "Wyoming"),
    ("district of columbia", "District of Columbia"), ("washington dc", "District of Columbia"), ("washington, d.c.", "District of Columbia"),
]

# Fixed values. Words that name a sponsor in a query, with what the sponsor's name must hold.
SPONSORS = [
    ("astrazeneca", "astrazeneca"),
    ("merck", "merck"), ("msd", "merck"),
    ("pfizer", "pfizer"),
    ("roche", "roche"), ("hoffmann-la roche", "roche"),
    ("genentech", "genentech"),
    ("novartis", "novartis"),
    ("eli lilly", "lilly"), ("lilly", "lilly"),
    ("janssen", "janssen"), ("johnson & johnson", "janssen"), ("j&j", "janssen"),
    ("gsk", "glaxosmithkline"), ("glaxosmithkline", "glaxosmithkline"),
    ("gilead", "gilead"),
    ("bristol-myers squibb", "bristol"), ("bristol myers squibb", "bristol"), ("bms", "bristol"),
    ("daiichi sankyo", "daiichi sankyo"), ("daiichi", "daiichi sankyo"),
    ("sanofi", "sanofi"),
    ("bayer", "bayer"),
    ("takeda", "takeda"),
    ("abbvie", "abbvie"),
    ("amgen", "amgen"),
    ("regeneron", "regeneron"),
    ("seagen", "seagen"), ("seattle genetics", "seagen"),
    ("incyte", "incyte"),
    ("moderna", "moderna"),
    ("biontech", "biontech"),
]

# Fixed values. Words that name a drug class in a query, with the class.
CLASS_WORDS = [
    ("adc", "ADC (antibody-drug conjugate)"), ("adcs", "ADC (antibody-drug conjugate)"), ("antibody-drug conjugate", "ADC (antibody-drug conjugate)"),
    ("antibody drug conjugate", "ADC (antibody-drug conjugate)"), ("antibody-drug conjugates", "ADC (antibody-drug conjugate)"),
    ("antibody drug conjugates", "ADC (antibody-drug conjugate)"),
    ("checkpoint inhibitor", "PD-(L)1 / immune checkpoint"), ("checkpoint inhibitors", "PD-(L)1 / immune checkpoint"),
    ("immune checkpoint", "PD-(L)1 / immune checkpoint"), ("immune checkpoint inhibitor", "PD-(L)1 / immune checkpoint"),
    ("ici", "PD-(L)1 / immune checkpoint"), ("pd-1 inhibitor", "PD-(L)1 / immune checkpoint"), ("pd-l1 inhibitor", "PD-(L)1 / immune checkpoint"),
    ("pd1 inhibitor", "PD-(L)1 / immune checkpoint"), ("pdl1 inhibitor", "PD-(L)1 / immune checkpoint"), ("pd-1", "PD-(L)1 / immune checkpoint"),
    ("pd-l1", "PD-(L)1 / immune checkpoint"), ("anti-pd-1", "PD-(L)1 / immune checkpoint"), ("anti-pd-l1", "PD-(L)1 / immune checkpoint"),
    ("parp inhibitor", "PARP inhibitor"), ("parp inhibitors", "PARP inhibitor"), ("parpi", "PARP inhibitor"),
    ("cdk4/6 inhibitor", "CDK4/6 inhibitor"), ("cdk4/6", "CDK4/6 inhibitor"), ("cdk inhibitor", "CDK4/6 inhibitor"),
    ("her2-targeted therapy", "HER2-targeted therapy"), ("her2-targeted", "HER2-targeted therapy"), ("her2 targeted", "HER2-targeted therapy"),
    ("anti-her2", "HER2-targeted therapy"),
    ("pi3k inhibitor", "AKT / PI3K / mTOR inhibitor"), ("akt inhibitor", "AKT / PI3K / mTOR inhibitor"), ("mtor inhibitor", "AKT / PI3K / mTOR inhibitor"),
    ("serd", "Endocrine / SERD / aromatase"), ("endocrine therapy", "Endocrine / SERD / aromatase"), ("aromatase inhibitor", "Endocrine / SERD / aromatase"),
    ("ar inhibitor", "AR-directed (LAR-TNBC)"), ("androgen receptor inhibitor", "AR-directed (LAR-TNBC)"),
    ("vegf inhibitor", "VEGF / anti-angiogenic"), ("anti-angiogenic", "VEGF / anti-angiogenic"), ("anti angiogenic", "VEGF / anti-angiogenic"),
    ("taxane", "Taxane chemotherapy"), ("taxanes", "Taxane chemotherapy"),
    ("platinum", "Platinum chemotherapy"), ("platinum chemotherapy", "Platinum chemotherapy"),
    ("anthracycline", "Anthracycline chemotherapy"), ("anthracyclines", "Anthracycline chemotherapy"),
]

# Fixed values. Drugs that stand for a class in a widened query.
CLASS_DRUGS = {
    "ADC (antibody-drug conjugate)": ("Datopotamab deruxtecan", "Trastuzumab deruxtecan", "Sacituzumab govitecan", "Dato-DXd", "T-DXd"),
    "PD-(L)1 / immune checkpoint": ("Pembrolizumab", "Atezolizumab", "Durvalumab", "Nivolumab"),
    "PARP inhibitor": ("Olaparib", "Talazoparib", "Niraparib"),
    "CDK4/6 inhibitor": ("Palbociclib", "Ribociclib", "Abemaciclib"),
    "HER2-targeted therapy": ("Trastuzumab", "Pertuzumab", "Tucatinib"),
    "AKT / PI3K / mTOR inhibitor": ("Capivasertib", "Alpelisib", "Inavolisib"),
    "Endocrine / SERD / aromatase": ("Fulvestrant", "Elacestrant", "Letrozole"),
    "AR-directed (LAR-TNBC)": ("Enzalutamide", "Bicalutamide"),
    "VEGF / anti-angiogenic": ("Bevacizumab", "Apatinib", "Anlotinib"),
    "Taxane chemotherapy": ("Paclitaxel", "Nab-paclitaxel", "Docetaxel"),
    "Platinum chemotherapy": ("Carboplatin", "Cisplatin"),
    "Anthracycline chemotherapy": ("Doxorubicin", "Epirubicin"),
}

# Fixed values. Drug classes with the pattern of their drugs' names, in the order in which equal counts are listed.
CLASS_PATTERNS = [
    ("PD-(L)1 / immune checkpoint", "pembrolizumab|atezolizumab|nivolumab|durvalumab|avelumab|cemiplimab|tislelizumab|toripalimab|camrelizumab|sintilimab|ipilimumab|tremelimumab|relatlimab|tiragolumab|checkpoint|anti.?pd.?l?1"),
    ("PARP inhibitor", r"olaparib|talazoparib|niraparib|rucaparib|veliparib|fluzoparib|pamiparib|\bparp\b"),
    ("ADC (antibody-drug conjugate)", r"sacituzumab|trastuzumab\s+deruxtecan|trastuzumab\s+emtansine|trodelvy|enhertu|kadcyla|datopotamab|patritumab\s+deruxtecan|disitamab|ladiratuzumab|mirvetuximab|antibody.?drug\s+conjugate"),
    ("HER2-targeted therapy", "trastuzumab|pertuzumab|tucatinib|lapatinib|neratinib|herceptin|perjeta|nerlynx|tukysa|margetuximab|zanidatamab"),
    ("CDK4/6 inhibitor", "palbociclib|ribociclib|abemaciclib|ibrance|kisqali|verzenio"),
    ("AKT / PI3K / mTOR inhibitor", r"capivasertib|ipatasertib|alpelisib|inavolisib|everolimus|temsirolimus|truqap|piqray|afinitor|\bakt\b|\bpi3k\b|\bmtor\b"),
    ("Endocrine / SERD / aromatase", "tamoxifen|fulvestrant|elacestrant|giredestrant|camizestrant|letrozole|anastrozole|exemestane|aromatase|orserdu"),
    ("AR-directed (LAR-TNBC)", r"enzalutamide|bicalutamide|abiraterone|apalutamide|darolutamide|androgen\s+receptor"),
    ("VEGF / anti-angiogenic", r"bevacizumab|ramucirumab|apatinib|anlotinib|sunitinib|sorafenib|cabozantinib|lenvatinib|axitinib|\bvegf\b|avastin"),
    ("Taxane chemotherapy", "paclitaxel|nab.?paclitaxel|abraxane|docetaxel|cabazitaxel"),
    ("Platinum chemotherapy", "carboplatin|cisplatin|oxaliplatin"),
    ("Anthracycline chemotherapy", "doxorubicin|epirubicin|adriamycin"),
    ("Alkylating chemotherapy", "cyclophosphamide|ifosfamide|temozolomide"),
    ("Capecitabine / 5-FU / gemcitabine", "capecitabine|5-fu|fluorouracil|gemcitabine|xeloda"),
    ("Eribulin", "eribulin|halaven"),
    ("Vaccine / cell therapy / TIL", r"\bvaccine\b|car.?t\b|\btils\b|tumor.?infiltrating|dendritic"),
    ("Radiation / radiotherapy", r"\bradiation\b|radiotherapy|sbrt|imrt|brachytherapy|proton\s+therapy"),
]

# Fixed values. Populations with their patterns; the first that matches counts.
DISEASES = [
    ("Triple-Negative Breast Cancer (TNBC)", r"triple[\s\-]*negative|\btnbc\b"),
    ("HR+ Breast Cancer", r"hr[\+\s\-]*positive|hormone[\s\-]*receptor[\s\-]*positive|\ber[\+\s\-]*positive\b|estrogen[\s\-]*receptor[\s\-]*positive"),
    ("HER2-Low Breast Cancer", r"her2[\s\-]*low\b"),
    ("HER2+ Breast Cancer", r"her2[\+\s\-]*positive|\bher2\+"),
    ("Inflammatory Breast Cancer", r"inflammatory[\s\-]*breast"),
    ("Ductal Carcinoma in Situ (DCIS)", r"\bdcis\b|ductal[\s\-]*carcinoma[\s\-]*in[\s\-]*situ"),
    ("Male Breast Cancer", r"male[\s\-]*breast"),
    ("Lobular Breast Cancer", r"lobular[\s\-]*(carcinoma|breast)"),
    ("Breast Cancer (general)", r"breast[\s\-]*(cancer|carcinoma|neoplasm|tumou?r)"),
]

# Fixed values. Statuses that a query may name, each match being used up before the next pattern.
STATUSES = [
    ("NOT_YET_RECRUITING", r"\bnot\s+yet\s+recruiting\b"),
    ("ACTIVE_NOT_RECRUITING", r"\bactive\s*,?\s*not\s+recruiting\b"),
    ("ENROLLING_BY_INVITATION", r"\benrolling\s+by\s+invitation\b"),
    ("RECRUITING", r"\b(currently\s+|actively\s+)?recruiting\b"),
    ("RECRUITING", r"\benrolling\b"),
    ("COMPLETED", r"\bcompleted\b"),
    ("TERMINATED", r"\bterminated\b"),
    ("WITHDRAWN", r"\bwithdrawn\b"),
    ("SUSPENDED", r"\bsuspended\b"),
]

# Fixed values. The one status of a conversation's filter; the first that matches counts.
ONE_STATUS = [
    ("NOT_YET_RECRUITING", r"not\s*yet\s*recruiting"),
    ("ACTIVE_NOT_RECRUITING", r"active[\s,]*not[\s\-]*recruiting"),
    ("RECRUITING", r"\b(recruiting|enrolling|actively\s+enrolling)\b"),
    ("COMPLETED", r"\bcompleted\b"),
    ("TERMINATED", r"\bterminated\b"),
    ("WITHDRAWN", r"\bwithdrawn\b"),
]

# Fixed values. Phases; the first that matches counts.
PHASES = [
    ("EARLY_PHASE1", r"early[\s\-]*phase[\s\-]*1\b"),
    ("PHASE4", r"\bphase[\s\-]*4\b"),
    ("PHASE3", r"\bphase[\s\-]*3\b"),
    ("PHASE2", r"\bphase[\s\-]*2\b"),
    ("PHASE1", r"\bphase[\s\-]*1\b"),
    ("PHASE4", r"\bphase[\s\-]*iv\b"),
    ("PHASE3", r"\bphase[\s\-]*iii\b"),
    ("PHASE2", r"\bphase[\s\-]*ii\b"),
    ("PHASE1", r"\bphase[\s\-]*i\b"),
]

# Fixed values. Study types; the first that matches counts.
STUDY_TYPES = [
    ("OBSERVATIONAL", r"\bobservational\b"),
    ("INTERVENTIONAL", r"\binterventional\b"),
    ("EXPANDED_ACCESS", r"\bexpanded[\s-]access\b"),
]

# Fixed values. Short names of populations; the first that matches counts.
SHORT_POPULATIONS = [
    ("TNBC", r"\btriple[\s-]?negative\b"),
    ("HER2-low", r"\bher2[\s-]?low\b"),
    ("HER2+", r"\bher2[\s-]?positive\b|\bher2\+\b"),
    ("HER2-", r"\bher2[\s-]?negative\b|\bher2\-\b"),
    ("HR+", r"\bhr[\s-]?positive\b|\bhr\+\b"),
    ("ER+", r"\ber[\s-]?positive\b|\ber\+\b"),
    ("BRCA", r"\bbrca\b"),
    ("metastatic", r"\bmetastatic\b"),
    ("early-stage", r"\bearly[\s-]?stage\b"),
    ("neoadjuvant", r"\bneoadjuvant\b"),
    ("adjuvant", r"(?<!neo)\badjuvant\b"),
]

# Fixed values. Treatment settings.
METASTATIC = r"\b(metastatic|advanced|stage\s*iv|stage\s*4|mbc)\b"
EARLY = r"\b(early|early-stage|non-metastatic|ebc|stage\s*i\b|stage\s*ii\b|stage\s*iii\b)"
EARLY_INTENT = r"\b(early|early-stage|ebc|non-metastatic)\b"
ADJUVANT = r"(?<!neo)\badjuvant\b"
NEOADJUVANT = r"\bneoadjuvant\b"

# Fixed values. Words by which a user asks for an earlier protocol.
EARLIER_PROTOCOL = [
    "previous report", "previous protocol", "previous draft", "last report", "last protocol", "last draft", "prior protocol", "earlier protocol",
    "the protocol i generated", "the report i generated", "based on the previous", "based on my previous", "edit my last", "modify my previous",
    "modify the previous", "update my previous", "from earlier", "the one we did",
]

# Fixed values. The forms of a confirmation.
CONFIRMATIONS = [
    r"(yes,?\s*)?(please\s+)?(apply|update|commit|incorporate|proceed|go ahead|do it|make (the|these|those)? ?changes?|approved?|confirmed?)( (it|them|all|now|please|the changes?|these changes?|those changes?|the feedback|the edits?|the protocol|the report|the draft))?",
    r"yes,?\s*please",
    r"yes,?\s*update",
    r"(yes,?\s*)?(please\s+)?apply (item ?s? )?\d+([\s,]+(and\s+)?\d+)*",
    r"(yes,?\s*)?(please\s+)?(update|commit) (item ?s? )?\d+([\s,]+(and\s+)?\d+)*",
    r"(apply )?all except (item ?s? )?\d+([\s,]+(and\s+)?\d+)*",
    r"skip (item ?s? )?\d+([\s,]+(and\s+)?\d+)*[, ]+(apply )?(the )?(rest|others?|remaining)",
    r"(go ahead and|let'?s) (apply|update|commit|do it|proceed|make (the|these|those)? ?changes?)( (it|them|all|the changes?|these changes?|those changes?))?",
    r"(sounds?|looks?) good,?\s*(apply|do it|proceed|go ahead|update|commit)",
    r"(yep|yup|yeah)",
    r"(ok|okay|sure),?\s*(apply|update|do it|proceed|go ahead|commit)",
]

# Fixed values. Display labels.
PHASE_LABELS = {"EARLY_PHASE1": "Early Phase 1", "PHASE1": "Phase 1", "PHASE2": "Phase 2", "PHASE3": "Phase 3", "PHASE4": "Phase 4"}
STATUS_LABELS = {
    "RECRUITING": "Recruiting", "NOT_YET_RECRUITING": "Not yet recruiting", "ACTIVE_NOT_RECRUITING": "Active, not recruiting",
    "COMPLETED": "Completed", "TERMINATED": "Terminated", "WITHDRAWN": "Withdrawn", "SUSPENDED": "Suspended", "UNKNOWN": "Unknown",
    "ENROLLING_BY_INVITATION": "Enrolling by invitation",
}

# Fixed values. Protocol fields that a version diff compares, in order.
DIFF_FIELDS = [
    "title", "official_title", "phase", "status", "conditions", "summary", "description", "primary_objectives", "secondary_objectives",
    "exploratory_objectives", "study_design", "study_schema", "intervention_name", "intervention_description", "comparator", "treatment_duration",
    "inclusion_criteria", "exclusion_criteria", "primary_endpoints", "secondary_endpoints", "estimated_enrollment", "sample_size_justification",
    "statistical_analysis", "safety_monitoring", "adverse_event_reporting", "dose_modification", "study_assessments", "study_schedule_table",
    "ethical_considerations", "data_management", "regulatory_considerations", "sex", "minimum_age", "references",
]

# Fixed values. Corpora: key, display name, condition asked for.
CORPORA = [
    ("breast_cancer", "Breast Cancer", "Breast Cancer"), ("lung_cancer", "Lung Cancer", "Lung Cancer"), ("lymphoma", "Lymphoma", "Lymphoma"),
    ("leukemia", "Leukemia", "Leukemia"), ("colorectal_cancer", "Colorectal Cancer", "Colon Cancer"), ("prostate_cancer", "Prostate Cancer", "Prostate Cancer"),
    ("liver_cancer", "Liver Cancer", "Liver Cancer"), ("ovarian_cancer", "Ovarian Cancer", "Ovarian Cancer"),
    ("pancreatic_cancer", "Pancreatic Cancer", "Pancreatic Cancer"), ("brain_cancer", "Brain Cancer", "Brain Cancer"),
    ("stomach_cancer", "Stomach Cancer", "Stomach Cancer"), ("melanoma", "Melanoma", "Melanoma"), ("bladder_cancer", "Bladder Cancer", "Bladder Cancer"),
]

# Fixed values. Labels of a document's text, with the trial column that follows each, in order.
TEXT_LABELS = [
    ("Title", "bTitle"), ("Official Title", "oTitle"), ("Acronym", "acronym"), ("Summary", "summary"), ("Description", "description"),
    ("Conditions", "conditions"), ("Keywords", "keywords"), ("MeSH Condition Terms", "meshTermsCondition"),
    ("MeSH Intervention Terms", "meshTermsIntervention"), ("Intervention", "interventionName"), ("Intervention Type", "interventionType"),
    ("Intervention Description", "interventionDescription"), ("Drug Aliases", "interventionOtherNames"), ("Arm Groups", "armGroups"),
    ("Inclusion Criteria", "includeCriteria"), ("Exclusion Criteria", "excludeCriteria"), ("Primary Outcomes", "primaryOutcomes"),
    ("Secondary Outcomes", "secondaryOutcomes"), ("Phase", "phases"), ("Status", "oStatus"), ("Study Type", "studyType"), ("Allocation", "allocation"),
    ("Intervention Model", "interventionModel"), ("Primary Purpose", "primaryPurpose"), ("Masking", "masking"), ("Sponsor", "sponsorName"),
    ("Principal Investigator", "piName"), ("PI Affiliation", "piAffiliation"), ("Location", "locationInfo"), ("Countries", "locationCountries"),
]

# Fixed values. Feedback and retrieval limits.
VOTE_UP, VOTE_DOWN, HALF_LIFE_DAYS, RERANK_CAP = 1.0, -1.5, 30.0, 0.05
EXAMPLES_PICKED, EXAMPLE_LEAST_ANSWER, EXAMPLE_SHOWN, EXAMPLE_LEAST_SIMILARITY = 2, 200, 1200, 0.15
CHAT_POOL, CHAT_BUDGET = 80, 12
