"""SQL fragments that several queries share; ``{0}`` stands for the column."""

#: Without white space at the ends.
W = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: White space collapsed.
SP = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
#: The host of ``website_url`` (contacts.host), null if there is none.
HOST = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(regexp_replace(website_url, '^\s+|\s+$', '', 'g')), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\.', ''), '')"
#: Whether a text is missing or stands for a missing value.
MISS = r"coalesce(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '') IN ('', 'null', 'none', 'nan')"
#: text.slugify: punctuation vanishes, blanks become hyphens.
SLUG = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-')"
#: text.county_slug: blanks and underscores become hyphens.
COUNTY_SLUG = r"trim(regexp_replace(regexp_replace(replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '_', '-'), '\s+', '-', 'g'), '-+', '-', 'g'), '-')"
