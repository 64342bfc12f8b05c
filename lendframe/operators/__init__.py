"""Reports, audits and circulation jobs over library tables."""
