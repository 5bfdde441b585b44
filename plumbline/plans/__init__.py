"""Planning of rule suites, failure pivots and reporting views."""
