"""Source trees, build files and the Java front end."""
