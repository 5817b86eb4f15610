"""Patterns, word lists and code tables."""

# They must equal the rules that the operators are specified by.
CPT = r"\b\d{5}\b"
ICD = r"\b[A-Z]\d{2}(\.[\dA-Z]{1,3})?\b"
SSN = r"\b\d{3}-?\d{2}-?\d{4}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
MONEY = [r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?", r"\d{1,3}(?:,\d{3})*\.\d{2}", r"\$\d+\.\d{2}"]
NPI = r"\b\d{10}\b"
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
CARD = r"\b\d{16}\b"
SLASH_DATE = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
PROCEDURE_WORDS = ["procedure", "treatment", "exam", "visit", "consultation", "surgery", "therapy", "injection", "test", "screening"]
DIAGNOSIS_WORDS = ["diagnosis", "condition", "disease", "disorder", "syndrome", "injury", "pain", "infection", "primary", "secondary"]
DATE_WORDS = ["date", "service", "visit", "admission", "discharge", "birth", "dob", "seen", "treated", "exam", "appointment", "schedule", "due", "issued", "effective", "onset", "start", "end", "through", "procedure", "surgery", "assessment"]
DATE_LABELS = ["dob:", "date of birth:", "dos:", "date of service:", "admission:", "discharge:", "date:", "seen on:", "as of:"]
MONEY_WORDS = ["charge", "fee", "cost", "amount", "payment", "copay", "deductible", "balance", "total", "bill", "invoice"]
PROVIDER_WORDS = ["npi", "provider", "physician", "doctor", "dr", "md", "nurse", "therapist", "practitioner", "clinic", "practice"]
NAME_PREFIXES = ["mr", "mrs", "ms", "dr", "doctor", "miss", "patient", "pt", "provider", "physician", "nurse"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "md", "do", "rn", "np", "pa"]
NOT_NAMES = ["and", "or", "the", "of", "in", "at", "on", "for", "with", "by", "from", "to", "date", "code", "number", "amount"]
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO",
    "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
STREETS = ["st", "street", "ave", "avenue", "blvd", "boulevard", "rd", "road", "dr", "drive", "ln", "lane", "ct", "court", "pl", "place", "way", "circle", "cir", "pkwy", "parkway"]
OCR_INDICATORS = ["patient", "diagnosis", "cpt", "icd", "procedure", "billing", "insurance", "provider", "npi", "date of service"]
OCR_MARKERS = ["<table>", "☐", "☑", "<img>", "<watermark>"]
LAYOUT_INDICATORS = ["\n", "\t", ":", "-", "•", "1.", "2.", "TABLE", "FORM"]
MEDICAL_TERMS = r"(?i)\b(patient|diagnosis|treatment|procedure|prescription|medication|dosage|icd|cpt|npi)\b"
STRUCTURE_MARKS = r"(<table>|</table>|<page|☐|☑|<img>|<watermark>)"
BOUNDARY_KEYWORDS = ["PATIENT", "NAME", "DOB", "ID", "ACCOUNT"]
STRONG_KEYWORDS = ["PATIENT", "NAME", "DOB"]
PATIENT_TERMS = ["name", "dob", "birth", "address", "phone", "id", "account"]
LINE_INDICATORS = ["patient", "pt", "name", "dob", "account"]
LINE_FIELDS = r"(?i)(name.*:|dob.*:|patient.*:|account.*:|id.*:)"
REPEATED_FIELDS = [r"(?i)Name:\s*[A-Za-z\s]+", r"(?i)DOB:\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"(?i)Patient\s+ID:\s*\w+", r"(?i)Account\s*#:\s*\w+", r"(?i)Service\s+Date:\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"]
DEMOGRAPHIC = [r"\bDOB\b", r"\bBIRTH\b", r"\bAGE\b", r"\bSEX\b", r"\bGENDER\b", r"\bADDRESS\b", r"\bPHONE\b", r"\bEMAIL\b", r"\bINSURANCE\b", r"\bPATIENT\s+ID\b", r"\bMEDICAL\s+RECORD\b", r"\bMRN\b", r"\bACCOUNT\s+NUMBER\b", r"\bSSN\b", r"\bSOCIAL\s+SECURITY\b", r"\bDATE\s+OF\s+SERVICE\b", r"\bSERVICE\s+DATE\b", r"\bDOS\b"]
#: In the second pattern a word of one letter ends the names; it is said by looking around, since Java repeats groups by recursion.
PATIENT_NAMES = [r"(?i)(?:PATIENT|PT|NAME)[:.\s]+((?:[A-Z][a-z]+\s+){1,2}[A-Z][a-z]+)", r"(?i)(?:LAST|FIRST)[:.\s]+([A-Z]{2}(?:(?!(?<![A-Z])[A-Z](?![A-Z]))[A-Z\s])*)"]
FORM_HEADERS = [r"(?i)PATIENT\s*INFORMATION", r"(?i)CLAIM\s*INFORMATION", r"(?i)INSURANCE\s*INFORMATION", r"(?i)ENCOUNTER\s*INFORMATION", r"(?i)VISIT\s*DETAILS"]
PERSON_FIELDS = [r"(?i)Name:\s*[A-Za-z\s.,'-]+", r"(?i)DOB:\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"(?i)Sex:\s*[MF]", r"(?i)Gender:\s*[MF]", r"(?i)Address:\s*[A-Za-z0-9\s.,'-]+", r"(?i)Phone:\s*[\d()-]+", r"(?i)MRN:\s*\w+", r"(?i)Account\s*#:\s*\w+", r"(?i)SSN:\s*[\dX-]+"]
BROKEN_PAGE = r"(?i)---\s*PAGE\s*BREAK\s*---"
PATIENT_IDS = [r"(?i)(?:MRN|ID)[:.\s]*([A-Za-z0-9-]+)", r"(?i)(?:PATIENT|PT)[\s#]+([A-Za-z0-9-]+)", r"(?i)ACCOUNT[\s#:]+([A-Za-z0-9-]+)"]
SEPARATORS = [r"-{10,}", r"={10,}", r"_{10,}", r"\*{10,}"]
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
FEMALE_PREFIXES, MALE_PREFIXES = ["5841", "5842", "5921"], ["5438", "5439", "5463"]
PEDIATRIC, GERIATRIC = ["99381", "99382", "99383", "99384"], ["99366", "99368"]
#: Procedure categories; the first range that holds a code counts.
CPT_RANGES = [("evaluation_management", 99202, 99499), ("anesthesia", 100, 1999), ("surgery", 10021, 69990), ("radiology", 70010, 79999), ("pathology_lab", 80047, 89398), ("medicine", 90281, 99607)]
CPT_CODES = {
    "99202": ("Office visit, new patient, straightforward", "evaluation_management"),
    "99203": ("Office visit, new patient, low complexity", "evaluation_management"),
    "99204": ("Office visit, new patient, moderate complexity", "evaluation_management"),
    "99205": ("Office visit, new patient, high complexity", "evaluation_management"),
    "99213": ("Office visit, established patient, low complexity", "evaluation_management"),
    "99214": ("Office visit, established patient, moderate complexity", "evaluation_management"),
    "99215": ("Office visit, established patient, high complexity", "evaluation_management"),
    "90834": ("Psychotherapy, 45 minutes", "medicine"),
    "90837": ("Psychotherapy, 60 minutes", "medicine"),
    "93000": ("Electrocardiogram, complete", "medicine"),
}
ICD_CODES = {
    "Z00.00": ("Encounter for general adult medical examination without abnormal findings", "Z00-Z13"),
    "Z12.31": ("Encounter for screening mammogram for malignant neoplasm of breast", "Z00-Z13"),
    "I10": ("Essential (primary) hypertension", "I00-I99"),
    "E11.9": ("Type 2 diabetes mellitus without complications", "E00-E89"),
    "M79.3": ("Panniculitis, unspecified", "M00-M99"),
    "F41.9": ("Anxiety disorder, unspecified", "F01-F99"),
    "J44.1": ("Chronic obstructive pulmonary disease with acute exacerbation", "J00-J99"),
    "N39.0": ("Urinary tract infection, site not specified", "N00-N99"),
}
#: Diagnosis chapters by the letters that their codes begin with.
ICD_CHAPTERS = {
    "A": "Certain infectious and parasitic diseases",
    "B": "Certain infectious and parasitic diseases",
    "C": "Neoplasms",
    "D": "Diseases of the blood and blood-forming organs",
    "E": "Endocrine, nutritional and metabolic diseases",
    "F": "Mental, Behavioral and Neurodevelopmental disorders",
    "G": "Diseases of the nervous system",
    "H": "Diseases of the eye and ear",
    "I": "Diseases of the circulatory system",
    "J": "Diseases of the respiratory system",
    "K": "Diseases of the digestive system",
    "L": "Diseases of the skin and subcutaneous tissue",
    "M": "Diseases of the musculoskeletal system",
    "N": "Diseases of the genitourinary system",
    "O": "Pregnancy, childbirth and the puerperium",
    "P": "Certain conditions originating in the perinatal period",
    "Q": "Congenital malformations, deformations and chromosomal abnormalities",
    "R": "Symptoms, signs and abnormal clinical and laboratory findings",
    "S": "Injury, poisoning and certain other consequences of external causes",
    "T": "Injury, poisoning and certain other consequences of external causes",
    "U": "Codes for special purposes",
    "V": "External causes of morbidity",
    "W": "External causes of morbidity",
    "X": "External causes of morbidity",
    "Y": "External causes of morbidity",
    "Z": "Factors influencing health status and contact with health services",
}
