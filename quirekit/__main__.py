"""python -m quirekit JOB ..., or the same by spark-submit."""

from quirekit.jobs import main

if __name__ == "__main__":
    main()
