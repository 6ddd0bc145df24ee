"""Taxonomies, weights, thresholds and column lists that results depend on."""

STATUSES = ("New", "Contacted", "Connected", "Qualified", "Opportunity", "Closed Won", "Closed Lost")
CHANNELS = ("Website", "Event", "LinkedIn", "Organic Search", "Referral", "Manual/Sales", "Other")
COUNTRY_ACRONYMS = {"uae": "UAE", "usa": "USA", "uk": "UK", "us": "US"}
LEGAL_TOKENS = tuple("""
    inc incorporated llc lc ltd ltda limited co corp corporation company
    gmbh ag kg mbh sarl sas sa srl spa nv bv ab as oy ap aps plc llp lp
    pte pty pt kk bros and
""".split())

# Points of a pair's signals.
EMAIL_EXACT, EMAIL_DOMAIN = 45, 8
PHONE_EXACT, PHONE_LAST9 = 40, 30
FAMILY_EXACT, FAMILY_SIMILAR, FAMILY_CONFLICT = 12, 6, -25
GIVEN_EXACT, GIVEN_PREFIX, GIVEN_INITIAL, GIVEN_CONFLICT = 15, 10, 5, -25
LOCALPART_NAME_DERIVED, LOCALPART_SIMILAR = 8, 4
COMPANY_SIMILAR, COUNTRY_EXACT, CREATED_SAME_DAY = 5, 4, 10

# Thresholds.
GIVEN_CONFLICT_BELOW = 0.60
GIVEN_PREFIX_LENGTH, GIVEN_PREFIX_GAP = 4, 3
FAMILY_SIMILAR_FROM, FAMILY_FUZZY_LENGTH = 0.90, 4
LOCALPART_SIMILAR_FROM, COMPANY_SIMILAR_FROM = 0.80, 0.60
HIGH_FROM, MEDIUM_FROM = 80, 35
BLOCK_MOST, GROUP_CHECK_MOST = 30, 10
DETAIL_MOST = 200
PAGE_SIZE, PAGE_MOST = 50, 200
GROUPS_SIZE, GROUPS_MOST = 50, 500

RAW_COLUMNS = (
    "Record ID", "First Name", "Last Name", "Full Name", "Job Title", "Company Name", "Email", "Phone Number",
    "Country/Region", "City", "Lead Status", "Lifecycle Stage", "Contact Owner", "Original Source",
    "Original Source Drill-Down 1", "Create Date", "Last Modified Date", "Notes", "Annual Revenue",
    "Marketing contact status", "GDPR consent", "Lead Score")
FORM_FIELDS = ("name", "email", "phone", "company", "country", "message", "form_id", "form_name", "page_url", "submitted_at")
LEAD_COLUMNS = (
    "id", "display_name", "given_name", "family_name", "family_key", "company", "company_norm", "job_title", "email",
    "email_local", "email_domain", "phone", "phone_digits", "phone_last9", "country", "status", "lifecycle_stage",
    "owner", "lead_score", "created_at", "last_modified_at", "notes", "source_channel", "source_detail",
    "source_confidence", "source_method", "source_needs_review", "raw_record")
EXPORT_COLUMNS = (
    "id", "display_name", "given_name", "family_name", "job_title", "company", "email", "phone", "country", "status",
    "lifecycle_stage", "owner", "created_at", "last_modified_at", "source_channel", "source_detail",
    "source_confidence", "source_needs_review", "lead_score", "notes")
