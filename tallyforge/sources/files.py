"""Small files and folders of any file system that Spark reads, by Spark's own Hadoop client."""

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def system(self, at: str):
        return self.path(at).getFileSystem(self.conf)

    def exists(self, at: str) -> bool:
        return self.system(at).exists(self.path(at))

    def names(self, at: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        return [s.getPath().getName() for s in self.system(at).listStatus(self.path(at))] if self.exists(at) else []

    def modified(self, at: str) -> float:
        """Seconds since 1970."""
        return self.system(at).getFileStatus(self.path(at)).getModificationTime() / 1000

    def size(self, at: str) -> tuple[int, int]:
        """(files, bytes) below a folder, by its listing alone; (0, 0) if there is none."""
        if not self.exists(at):
            return 0, 0
        found = self.system(at).getContentSummary(self.path(at))
        return found.getFileCount(), found.getLength()

    def read(self, at: str) -> str:
        stream = self.system(at).open(self.path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, at: str, text: str) -> bool:
        """Writes a file whole or not at all: under another name, then by one rename, which fails if
        the name is taken by then; whether it was free. (Object stores without such a rename need a
        committer of their own.)"""
        folder, _, name = at.rpartition("/")
        self.system(folder).mkdirs(self.path(folder))
        draft = f"{folder}/.{name}-{self.jvm.java.util.UUID.randomUUID()}"
        out = self.system(draft).create(self.path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        kinds = self.spark._sc._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE
        try:
            source, target = (self.system(at).makeQualified(self.path(x)) for x in (draft, at))
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, target, kinds)
        except Exception as e:
            self.delete(draft)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, at: str) -> None:
        self.system(at).delete(self.path(at), True)
