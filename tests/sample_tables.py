"""Where the small sample tables are; a module of its own, as conftest modules cannot be imported by name."""

SF = "/root/testdata/sf0.001"
