"""Tables in and out, fixed code lists, and the binding to the star-schema files."""
