"""Labelled text in everyday words, which the documents' own sentences lack: fixed values, written for this package."""

from __future__ import annotations

# One passage a language, of frequent words and of what programmers write about.
SEEDS = {
    "en": """
We use this value because it is the only one that the server will accept. If there are no more items, the loop ends and nothing is returned to the caller. You can change this later, but be careful not to break what other people already rely on.
It would be better to move this into its own module, since we have to do the same thing in several places. They should have been told about it before the release. Make sure that the user is logged in and has the right to see the page. When the
connection is closed we try again after a few seconds, up to three times. Please note that these settings are read once at start and cannot be changed while the program is running. What happens here is not very clear to me; maybe somebody who
knows the old system can explain it. Do not call this method directly, use the one above instead. She said that her team does not want to wait for us any longer. I think he was right about most of it, though some things have changed since then.
There is a bug in the way we handle dates, which is why the first day of the month is sometimes missing. This is a temporary workaround until the new version is out. Every time a message comes in, we look it up by its name and then decide where it
should go. The following example shows how to create a new account and send an email. Could not open the file: it does not exist or you have no permission to read it. An error occurred while we were trying to save your changes. Are you sure you
want to delete all of this? It will not be possible to get it back. Wait until both of them are done, then check whether the results are equal. Without this line the test would fail on some machines. Those who need it can turn it on with the
option below. We are only interested in the last part, so everything else is thrown away. How many times must a request be sent before we give up? At least two, and at most five. Although it looks simple, there has been a lot of work behind
it. Enter your password again to continue. Your order has been received and will be shipped within two days. Thank you for your help, and let us know if anything goes wrong with it. Choose a color, a size or both from this list.
""",
    "de": """
Wir verwenden diesen Wert, weil der Server nur ihn annimmt. Wenn keine weiteren Einträge vorhanden sind, endet die Schleife und es wird nichts zurückgegeben. Man kann das später noch ändern, sollte aber nichts kaputt machen, worauf sich andere
schon verlassen. Es wäre besser, dies in ein eigenes Modul zu verschieben, da wir an mehreren Stellen dasselbe tun müssen. Bitte beachten Sie, dass die Einstellungen nur beim Start gelesen werden und während der Laufzeit nicht geändert werden
können. Was hier passiert, ist mir nicht ganz klar; vielleicht kann es jemand erklären, der das alte System kennt. Diese Methode bitte nicht direkt aufrufen, sondern die obere benutzen. Sie sagte, dass ihr Team nicht länger auf uns warten will.
Ich glaube, er hatte damit recht, auch wenn sich seitdem einiges geändert hat. Es gibt einen Fehler bei der Behandlung von Daten, deshalb fehlt manchmal der erste Tag des Monats. Das ist nur eine Übergangslösung, bis die neue Version erscheint.
Jedes Mal, wenn eine Nachricht ankommt, suchen wir sie nach ihrem Namen und entscheiden dann, wohin sie gehen soll. Das folgende Beispiel zeigt, wie man ein neues Konto anlegt und eine Mail verschickt. Die Datei konnte nicht geöffnet werden: sie
ist nicht vorhanden oder Sie haben keine Rechte. Beim Speichern Ihrer Änderungen ist ein Fehler aufgetreten. Möchten Sie wirklich alles löschen? Das kann nicht rückgängig gemacht werden. Erst warten, bis beide fertig sind, und danach prüfen, ob
die Ergebnisse gleich sind. Ohne diese Zeile würde der Test auf einigen Rechnern fehlschlagen. Uns interessiert nur der letzte Teil, alles andere wird verworfen. Wie oft muss eine Anfrage gesendet werden, bevor wir aufgeben? Mindestens zweimal,
höchstens fünfmal. Obwohl es einfach aussieht, steckt viel Arbeit dahinter. Geben Sie Ihr Passwort noch einmal ein, um fortzufahren. Vielen Dank für deine Hilfe, und sag uns Bescheid, wenn etwas damit nicht stimmt. Dieser Benutzer hat keinen
Zugriff auf die Seite. Der Wert darf nicht leer sein und muss zwischen eins und zehn liegen. Hier werden zuerst die Zeilen gelesen und dann nach Größe sortiert. Wird nur noch aus Gründen der Kompatibilität gebraucht. Wähle eine Farbe aus der Liste.
""",
    "fr": """
Nous utilisons cette valeur parce que c'est la seule que le serveur accepte. S'il n'y a plus d'éléments, la boucle se termine et rien n'est renvoyé. On peut la changer plus tard, mais il faut faire attention à ne pas casser ce dont les autres ont
besoin. Il vaudrait mieux mettre cela dans un module à part, car nous devons faire la même chose à plusieurs endroits. Veuillez noter que ces réglages sont lus une seule fois au démarrage et ne peuvent pas être modifiés pendant que le programme
tourne. Ce qui se passe ici n'est pas très clair pour moi ; peut-être que quelqu'un qui connaît l'ancien système peut l'expliquer. N'appelez pas cette méthode directement, utilisez plutôt celle du dessus. Elle a dit que son équipe ne veut plus
nous attendre. Je pense qu'il avait raison sur l'essentiel, même si certaines choses ont changé depuis. Il y a une erreur dans la façon dont nous traitons les dates, c'est pourquoi le premier jour du mois manque parfois. C'est une solution
provisoire en attendant la nouvelle version. Chaque fois qu'un message arrive, nous le cherchons par son nom, puis nous décidons où il doit aller. L'exemple suivant montre comment créer un nouveau compte et envoyer un courriel. Impossible d'ouvrir
le fichier : il n'existe pas ou vous n'avez pas le droit de le lire. Une erreur est survenue lors de l'enregistrement de vos modifications. Voulez-vous vraiment tout supprimer ? Cette action est définitive. Attendre que les deux soient finis,
puis vérifier si les résultats sont égaux. Sans cette ligne, le test échouerait sur certaines machines. Seule la dernière partie nous intéresse, tout le reste est jeté. Combien de fois faut-il envoyer une demande avant d'abandonner ? Au moins deux
fois, au plus cinq. Bien que cela paraisse simple, il y a beaucoup de travail derrière. Saisissez à nouveau votre mot de passe pour continuer. Merci de votre aide, et dites-nous si quelque chose ne va pas. Cet utilisateur n'a pas accès à la page.
La valeur ne doit pas être vide et doit être comprise entre un et dix. On lit d'abord les lignes, ensuite on les trie par taille. Choisissez une couleur dans la liste, puis cliquez sur le bouton.
""",
    "es": """
Usamos este valor porque es el único que acepta el servidor. Si no hay más elementos, el bucle termina y no se devuelve nada. Se puede cambiar más tarde, pero hay que tener cuidado de no romper lo que otros ya necesitan. Sería mejor pasar esto a su
propio módulo, ya que tenemos que hacer lo mismo en varios lugares. Tenga en cuenta que estos ajustes se leen una sola vez al inicio y no pueden modificarse mientras el programa está en marcha. Lo que pasa aquí no me queda muy claro; quizás alguien
que conozca el sistema antiguo pueda explicarlo. No llame a este método directamente, utilice el de arriba. Ella dijo que su equipo no quiere esperarnos más. Creo que él tenía razón en casi todo, aunque algunas cosas han cambiado desde entonces.
Hay un error en la forma en que tratamos las fechas, por eso a veces falta el primer día del mes. Es una solución temporal hasta que salga la nueva versión. Cada vez que llega un mensaje, lo buscamos por su nombre y luego decidimos adónde debe ir.
El siguiente ejemplo muestra cómo crear una cuenta nueva y enviar un correo. No se pudo abrir el archivo: no existe o usted no tiene permiso para leerlo. Se ha producido un error al guardar los cambios. ¿Está seguro de que desea borrar todo esto?
No será posible recuperarlo. Espere a que los dos hayan terminado y después compruebe si los resultados son iguales. Sin esta línea la prueba fallaría en algunas máquinas. Solo nos interesa la última parte, todo lo demás se descarta. ¿Cuántas
veces hay que enviar una petición antes de rendirse? Al menos dos, y como mucho cinco. Aunque parezca sencillo, hay mucho trabajo detrás. Introduzca de nuevo su contraseña para continuar. Gracias por tu ayuda, y avísanos si algo va mal. Este usuario
no tiene acceso a la página. El valor no debe estar vacío y tiene que estar entre uno y diez. Primero se leen las filas y luego se ordenan por tamaño. Elige un color de la lista y pulsa el botón.
""",
    "pt": """
Usamos este valor porque é o único que o servidor aceita. Se não houver mais itens, o laço termina e nada é devolvido. Isto pode ser alterado mais tarde, mas é preciso ter cuidado para não estragar o que os outros já usam. Seria melhor mover isso
para um módulo próprio, pois temos de fazer a mesma coisa em vários lugares. Observe que estas configurações são lidas apenas uma vez no início e não podem ser mudadas enquanto o programa está em execução. O que acontece aqui não está muito claro
para mim; talvez alguém que conheça o sistema antigo possa explicar. Não chame este método diretamente, use o de cima. Ela disse que a sua equipe não quer mais esperar por nós. Acho que ele tinha razão em quase tudo, embora algumas coisas tenham
mudado desde então. Há um erro na forma como tratamos as datas, por isso às vezes falta o primeiro dia do mês. É uma solução temporária até sair a nova versão. Cada vez que chega uma mensagem, procuramos pelo nome e depois decidimos para onde ela
deve ir. O exemplo a seguir mostra como criar uma conta nova e enviar um email. Não foi possível abrir o arquivo: ele não existe ou você não tem permissão para ler. Ocorreu um erro ao salvar as suas alterações. Tem certeza de que deseja apagar
tudo isto? Não será possível recuperar. Espere até que os dois tenham terminado e então verifique se os resultados são iguais. Sem esta linha o teste falharia em algumas máquinas. Só nos interessa a última parte, todo o resto é descartado. Quantas
vezes um pedido deve ser enviado antes de desistir? Pelo menos duas, e no máximo cinco. Embora pareça simples, há muito trabalho por trás. Digite a senha novamente para continuar. Obrigado pela ajuda, e avise se algo der errado. Este usuário não
tem acesso à página. O valor não pode ser vazio e tem de estar entre um e dez. Primeiro são lidas as linhas e depois são ordenadas pelo tamanho. Escolha uma cor da lista e clique no botão.
""",
    "it": """
Usiamo questo valore perché è l'unico che il server accetta. Se non ci sono più elementi, il ciclo finisce e non viene restituito nulla. Si può cambiare più tardi, ma bisogna fare attenzione a non rompere quello che serve agli altri. Sarebbe meglio
spostarlo in un modulo a parte, dato che dobbiamo fare la stessa cosa in diversi punti. Si noti che queste impostazioni vengono lette una sola volta all'avvio e non possono essere modificate mentre il programma è in esecuzione. Quello che succede
qui non mi è molto chiaro; forse qualcuno che conosce il vecchio sistema può spiegarlo. Non chiamare direttamente questo metodo, usa invece quello sopra. Ha detto che la sua squadra non vuole più aspettarci. Penso che avesse ragione su quasi tutto,
anche se da allora alcune cose sono cambiate. C'è un errore nel modo in cui trattiamo le date, per questo a volte manca il primo giorno del mese. È una soluzione temporanea finché non esce la nuova versione. Ogni volta che arriva un messaggio, lo
cerchiamo per nome e poi decidiamo dove deve andare. L'esempio seguente mostra come creare un nuovo account e inviare una mail. Impossibile aprire il file: non esiste oppure non hai il permesso di leggerlo. Si è verificato un errore durante il
salvataggio delle modifiche. Sei sicuro di voler cancellare tutto? Non sarà possibile recuperarlo. Aspettare che entrambi abbiano finito, quindi controllare se i risultati sono uguali. Senza questa riga il test fallirebbe su alcune macchine. Ci
interessa solo l'ultima parte, tutto il resto viene scartato. Quante volte si deve inviare una richiesta prima di rinunciare? Almeno due, e al massimo cinque. Anche se sembra semplice, c'è molto lavoro dietro. Inserisci di nuovo la tua password per
continuare. Grazie per il tuo aiuto, e facci sapere se qualcosa non va. Questo utente non ha accesso alla pagina. Il valore non deve essere vuoto e deve essere compreso tra uno e dieci. Prima si leggono le righe, poi vengono ordinate per dimensione.
""",
    "nl": """
We gebruiken deze waarde omdat het de enige is die de server accepteert. Als er geen items meer zijn, stopt de lus en wordt er niets teruggegeven. Je kunt dit later nog veranderen, maar pas op dat je niets kapot maakt waar anderen al op vertrouwen.
Het zou beter zijn om dit naar een eigen module te verplaatsen, want we moeten op meerdere plaatsen hetzelfde doen. Let op: deze instellingen worden alleen bij het starten gelezen en kunnen niet worden aangepast terwijl het programma draait. Wat
hier gebeurt is mij niet helemaal duidelijk; misschien kan iemand die het oude systeem kent het uitleggen. Roep deze methode niet direct aan, gebruik liever die hierboven. Ze zei dat haar team niet langer op ons wil wachten. Ik denk dat hij
grotendeels gelijk had, al zijn sommige dingen sindsdien veranderd. Er zit een fout in de manier waarop we datums behandelen, daarom ontbreekt soms de eerste dag van de maand. Dit is een tijdelijke oplossing tot de nieuwe versie uit is. Elke keer
als er een bericht binnenkomt, zoeken we het op naam en beslissen dan waar het naartoe moet. Het volgende voorbeeld laat zien hoe je een nieuw account aanmaakt en een mail verstuurt. Kan het bestand niet openen: het bestaat niet of je hebt geen
rechten om het te lezen. Er is een fout opgetreden bij het opslaan van uw wijzigingen. Weet u zeker dat u dit allemaal wilt verwijderen? Het kan niet ongedaan worden gemaakt. Wacht tot beide klaar zijn en controleer daarna of de resultaten gelijk
zijn. Zonder deze regel zou de test op sommige machines mislukken. Alleen het laatste deel is voor ons van belang, de rest wordt weggegooid. Hoe vaak moet een verzoek worden verstuurd voordat we het opgeven? Ten minste twee keer, hoogstens vijf.
Hoewel het eenvoudig lijkt, zit er veel werk achter. Voer uw wachtwoord opnieuw in om door te gaan. Bedankt voor je hulp, en laat het ons weten als er iets mis gaat. Deze gebruiker heeft geen toegang tot de pagina. De waarde mag niet leeg zijn en
moet tussen een en tien liggen. Eerst worden de rijen gelezen en daarna gesorteerd op grootte. Kies een kleur uit de lijst en klik op de knop.
""",
    "pl": """
Używamy tej wartości, ponieważ tylko ją przyjmuje serwer. Jeśli nie ma więcej elementów, pętla się kończy i nic nie jest zwracane. Można to później zmienić, ale trzeba uważać, żeby nie zepsuć tego, na czym polegają inni. Lepiej byłoby przenieść to
do osobnego modułu, bo musimy robić to samo w kilku miejscach. Proszę pamiętać, że te ustawienia są czytane tylko raz przy starcie i nie można ich zmienić, gdy program działa. To, co się tutaj dzieje, nie jest dla mnie jasne; może ktoś, kto zna
stary system, potrafi to wyjaśnić. Nie wywołuj tej metody bezpośrednio, użyj tej powyżej. Powiedziała, że jej zespół nie chce już na nas czekać. Myślę, że miał rację prawie we wszystkim, chociaż od tego czasu niektóre rzeczy się zmieniły. Jest błąd
w sposobie obsługi dat, dlatego czasami brakuje pierwszego dnia miesiąca. To tymczasowe rozwiązanie, dopóki nie wyjdzie nowa wersja. Za każdym razem, gdy przychodzi wiadomość, szukamy jej po nazwie, a potem decydujemy, dokąd ma trafić. Poniższy
przykład pokazuje, jak utworzyć nowe konto i wysłać list. Nie można otworzyć pliku: nie istnieje albo nie masz prawa go odczytać. Wystąpił błąd podczas zapisywania zmian. Czy na pewno chcesz to wszystko usunąć? Nie będzie można tego odzyskać.
Poczekaj, aż oba się skończą, a następnie sprawdź, czy wyniki są równe. Bez tego wiersza test nie powiódłby się na niektórych maszynach. Interesuje nas tylko ostatnia część, cała reszta jest odrzucana. Ile razy trzeba wysłać żądanie, zanim się
poddamy? Co najmniej dwa, a najwyżej pięć. Choć wygląda to prosto, kryje się za tym dużo pracy. Wpisz ponownie hasło, aby kontynuować. Dziękujemy za pomoc i daj nam znać, jeśli coś pójdzie nie tak. Ten użytkownik nie ma dostępu do strony. Wartość
nie może być pusta i musi być pomiędzy jeden a dziesięć. Najpierw czytane są wiersze, a później są sortowane według rozmiaru. Wybierz kolor z listy i kliknij przycisk.
""",
    "ru": """
Мы используем это значение, потому что сервер принимает только его. Если элементов больше нет, цикл завершается и ничего не возвращается. Потом это можно изменить, но нужно быть осторожным, чтобы не сломать то, на что уже рассчитывают другие.
Лучше было бы вынести это в отдельный модуль, так как нам приходится делать одно и то же в нескольких местах. Обратите внимание, что эти настройки читаются один раз при запуске и не могут быть изменены во время работы программы. То, что здесь
происходит, мне не очень понятно; может быть, кто-то, кто знает старую систему, сможет объяснить. Не вызывайте этот метод напрямую, используйте тот, что выше. Она сказала, что её команда больше не хочет нас ждать. Я думаю, он был прав почти во
всём, хотя с тех пор кое-что изменилось. Есть ошибка в том, как мы обрабатываем даты, поэтому иногда пропадает первый день месяца. Это временное решение, пока не выйдет новая версия. Каждый раз, когда приходит сообщение, мы ищем его по имени, а
затем решаем, куда оно должно попасть. Следующий пример показывает, как создать новую учётную запись и отправить письмо. Не удалось открыть файл: он не существует или у вас нет прав на чтение. При сохранении ваших изменений произошла ошибка. Вы
уверены, что хотите удалить всё это? Восстановить будет нельзя. Подождите, пока оба закончат, и затем проверьте, равны ли результаты. Без этой строки тест не пройдёт на некоторых машинах. Нас интересует только последняя часть, всё остальное
отбрасывается. Сколько раз надо отправить запрос, прежде чем сдаться? Не меньше двух и не больше пяти. Хотя это выглядит просто, за этим стоит много работы. Введите пароль ещё раз, чтобы продолжить. Спасибо за помощь, и дайте нам знать, если
что-то пойдёт не так. У этого пользователя нет доступа к странице. Значение не должно быть пустым. Сначала читаются строки, потом они сортируются по размеру. Выберите цвет из списка и нажмите на кнопку.
""",
    "tr": """
Bu değeri kullanıyoruz çünkü sunucu yalnızca bunu kabul ediyor. Başka öğe kalmadıysa döngü biter ve hiçbir şey döndürülmez. Bunu daha sonra değiştirebilirsiniz, ama başkalarının kullandığı şeyleri bozmamaya dikkat edin. Aynı şeyi birkaç yerde yapmak
zorunda olduğumuz için bunu kendi modülüne taşımak daha iyi olurdu. Bu ayarların yalnızca başlangıçta bir kez okunduğunu ve program çalışırken değiştirilemeyeceğini unutmayın. Burada ne olduğu benim için çok açık değil; belki eski sistemi bilen biri
açıklayabilir. Bu yöntemi doğrudan çağırmayın, onun yerine yukarıdakini kullanın. Ekibinin artık bizi beklemek istemediğini söyledi. Bence çoğu konuda haklıydı, ancak o zamandan beri bazı şeyler değişti. Tarihleri işleme biçimimizde bir hata var,
bu yüzden bazen ayın ilk günü eksik oluyor. Yeni sürüm çıkana kadar bu geçici bir çözümdür. Her mesaj geldiğinde onu adına göre arıyoruz ve sonra nereye gitmesi gerektiğine karar veriyoruz. Aşağıdaki örnek yeni bir hesabın nasıl oluşturulacağını ve
bir e-postanın nasıl gönderileceğini gösterir. Dosya açılamadı: mevcut değil veya okuma izniniz yok. Değişiklikleriniz kaydedilirken bir hata oluştu. Bunların hepsini silmek istediğinizden emin misiniz? Geri almak mümkün olmayacak. İkisi de bitene
kadar bekleyin, ardından sonuçların eşit olup olmadığını kontrol edin. Bu satır olmadan test bazı makinelerde başarısız olur. Bizi sadece son kısım ilgilendiriyor, geri kalan her şey atılır. Vazgeçmeden önce bir istek kaç kez gönderilmelidir? En az
iki, en çok beş. Basit görünse de arkasında çok fazla iş var. Devam etmek için parolanızı tekrar girin. Yardımınız için teşekkürler, bir şey ters giderse bize haber verin. Bu kullanıcının sayfaya erişimi yok. Değer boş olamaz ve bir ile on arasında
olmalıdır. Önce satırlar okunur, sonra boyuta göre sıralanır. Listeden bir renk seçin ve düğmeye tıklayın.
""",
    "ja": """
サーバーが受け付けるのはこの値だけなので、これを使っています。要素がなくなったらループを終了し、何も返しません。後で変更することもできますが、他の人が使っているものを壊さないように注意してください。同じことを何か所かで行う必要があるため、別のモジュールに移した方がよいでしょう。
これらの設定は起動時に一度だけ読み込まれ、プログラムの実行中は変更できません。ここで何が起きているのかよく分かりません。古いシステムを知っている人なら説明できるかもしれません。このメソッドを直接呼び出さないで、上のものを使ってください。日付の扱いに誤りがあり、月の最初の日が抜けることがあります。
これは新しいバージョンが出るまでの一時的な対応です。メッセージが届くたびに名前で検索し、どこへ送るかを決めます。次の例では新しいアカウントを作成してメールを送る方法を示します。ファイルを開けませんでした。存在しないか、読み取る権限がありません。変更を保存中にエラーが発生しました。
本当にすべて削除してもよろしいですか。元に戻すことはできません。両方が終わるまで待ってから、結果が等しいかどうかを確認します。この行がないと、一部の環境でテストが失敗します。必要なのは最後の部分だけで、残りは捨てられます。続けるにはパスワードをもう一度入力してください。
このユーザーにはページを見る権限がありません。値は空にできません。まず行を読み込み、それから大きさの順に並べ替えます。一覧から色を選んでボタンを押してください。ご協力ありがとうございます。問題があればお知らせください。データが見つからない場合はデフォルトの値を返すようにする。
""",
    "zh": """
我们使用这个值，因为服务器只接受它。如果没有更多的元素，循环就结束，不返回任何内容。以后可以修改，但要小心不要破坏其他人已经依赖的东西。最好把它移到单独的模块里，因为我们要在好几个地方做同样的事情。请注意，这些设置只在启动时读取一次，程序运行期间不能更改。
我不太清楚这里发生了什么，也许了解旧系统的人可以解释。不要直接调用这个方法，请使用上面的那个。处理日期的方式有一个错误，所以有时会缺少每个月的第一天。这只是新版本发布之前的临时解决办法。每当收到一条消息，我们就按名称查找，然后决定应该发送到哪里。
下面的例子说明如何创建新的账户并发送邮件。无法打开文件：文件不存在，或者您没有读取权限。保存更改时发生错误。您确定要删除所有这些内容吗？删除后将无法恢复。等到两个都完成，再检查结果是否相等。没有这一行，测试在某些机器上会失败。我们只关心最后一部分，其余的都会被丢弃。
请再次输入密码以继续。该用户没有访问此页面的权限。这个值不能为空，必须在一到十之间。首先读取所有的行，然后按大小排序。从列表中选择一种颜色，然后点击按钮。感谢您的帮助，如果有问题请告诉我们。如果找不到数据就返回默认值。当用户已经登录的时候，可以看到自己的订单和地址。
""",
    "ko": """
서버가 이 값만 받기 때문에 이 값을 사용합니다. 더 이상 항목이 없으면 반복을 끝내고 아무것도 반환하지 않습니다. 나중에 바꿀 수 있지만 다른 사람이 이미 쓰고 있는 것을 망가뜨리지 않도록 주의하세요. 여러 곳에서 같은 일을 해야 하므로 별도의 모듈로 옮기는 것이 더 좋습니다.
이 설정은 시작할 때 한 번만 읽으며 프로그램이 실행되는 동안에는 변경할 수 없습니다. 여기서 무슨 일이 일어나는지 잘 모르겠습니다. 예전 시스템을 아는 사람이 설명할 수 있을지도 모릅니다. 이 메서드를 직접 호출하지 말고 위에 있는 것을 사용하세요.
날짜를 처리하는 방식에 오류가 있어서 가끔 매월 첫째 날이 빠집니다. 새 버전이 나올 때까지 쓰는 임시 방법입니다. 메시지가 올 때마다 이름으로 찾아서 어디로 보낼지 결정합니다. 다음 예제는 새 계정을 만들고 메일을 보내는 방법을 보여 줍니다.
파일을 열 수 없습니다. 파일이 없거나 읽을 권한이 없습니다. 변경 내용을 저장하는 중에 오류가 발생했습니다. 정말 모두 삭제하시겠습니까? 되돌릴 수 없습니다. 둘 다 끝날 때까지 기다린 다음 결과가 같은지 확인합니다. 이 줄이 없으면 일부 컴퓨터에서 테스트가 실패합니다.
마지막 부분만 필요하고 나머지는 버립니다. 계속하려면 비밀번호를 다시 입력하세요. 이 사용자는 페이지에 접근할 수 없습니다. 값은 비어 있으면 안 됩니다. 먼저 줄을 읽고 그다음 크기 순서로 정렬합니다. 목록에서 색을 고르고 버튼을 누르세요. 도와주셔서 감사합니다. 문제가 있으면 알려 주세요.
""",
}

# Frequent words beside the passages: before the stroke those that hold sentences together, behind it those of programs' users and writers.
WORDS = {
    "en": """a an and any are as at be been before being between both but by can could did does doing during each either else ever few found from gives going had has have having he her here him his how however i if in
    instead into is it its just keep kept least less let like made make makes many may might more most much must my near need needs neither never next no nor not now of off often on once one only onto or order
    other others our out over own passes perhaps please possible rather really return returns same second see seem seems seen several shall should show shows side since so some something soon
    such sure take takes taken than that the their them then there these they thing things this those through to today together too two under until upon us using
    usually very want wants was way we well were what when where whether which while who whole whose why will with within without working would written yet you your | called contains converts checks
    creates defines describes determines ensures expects finds handles holds includes indicates loads means prints provides reads removes represents sends specifies stores updates required available already existing currently
    automatically empty invalid missing current previous following different single multiple between both whenever everything nothing another because although string list items element elements function method class field file files line lines page large last left order part parts pass point place people right set simple single size small start started starts state still stop text time true turn use used useful user users uses using value values work works write word words wrong year years first long little given number old new good great up down""",
    "de": """aber alle allem allen aller alles als also am an ander anderen andere auch auf aus außerdem bei beim bereits besser bin bis bist bleibt da dabei dadurch dafür damit danach dann darf das dass dem den denn der deren des deshalb dich die dies diese
    diesem diesen dieser dieses doch dort du durch eben ein eine einem einen einer eines einfach einige einmal er erst es etwa etwas euch für ganz gegen gibt gut hat hatte hätte hier hinter ich ihm ihn ihnen ihr ihre im immer in innerhalb ins ist ja jede
    jeden jeder jedoch jetzt kann kein keine können könnte lang lange leer letzte liegt macht man mehr mein mit muss müssen nach nächste neben nein neu nicht nichts noch nun nur ob oben oder ohne per richtig schon sehr sein seine seit selbst sich sie sind so
    sobald soll sollen sollte sondern sonst sowie über um und unser unten unter viel viele vom von vor war waren warum was wegen weil weiter welche wenn wer werden wie wieder wir wird wo wurde wurden würde zeigt zu zum zur zurück zwar zwei zwischen
    | Anzahl Liste Zeichenkette Funktion Methode Klasse Feld Zeile Seite Zustand Schlüssel Fehler Ergebnis Eingabe Ausgabe Ordner Verzeichnis Verbindung Benutzer Nachricht Prüfung überprüft berechnet enthält erstellt liefert löscht speichert setzt bestimmt
    aktuelle vorherige folgende verschiedene mehrere einzelne vorhandene erforderlich verfügbar ungültig fehlende automatisch Bestellung Kunde Preis Bildschirm Fenster Schaltfläche Gerät Zeitpunkt Stunde Tage Woche Jahr""",
    "fr": """a à afin ai aie ainsi alors après as au aucun aucune aujourd'hui aussi autre autres aux avant avec avoir bien c'est ça car ce ceci cela celle celui ces cet cette ceux chaque chez comme comment contre d'un d'une dans de déjà depuis des dès deux doit
    doivent donc dont du elle elles en encore entre est et étaient était être eu fait faut fois font fut grand ici il ils j'ai jamais je l'on la là laquelle le lequel les leur leurs lors lorsque lui mais même mêmes mes mon n'a n'est ne ni non nos notre nous
    nouveau on ont ou où par parce pas peu peut peuvent plus plusieurs pour pourquoi pourrait puis qu'il qu'on quand que quel quelle quelques qui quoi sa sans se selon sera ses seul seulement seront si sinon soit son sont sous souvent sur ta tant te
    tel tes toi ton toujours tous tout toute toutes très trop tu un une va vers voir vos votre vous vrai y | nombre liste chaîne fonction méthode classe champ ligne état clé erreur résultat entrée sortie dossier répertoire connexion utilisateur vérifie calcule contient
    crée renvoie retourne supprime enregistre définit détermine permet indique actuel actuelle précédent suivante différents vide invalide manquant disponible nécessaire automatiquement commande client prix écran fenêtre bouton appareil heure jours semaine année""",
    "es": """a al algo alguien algún alguna antes aquí así aún aunque bajo bien cada casi como cómo con contra cual cualquier cuando cuánto de debe deben debería del dentro desde después detrás dicha dicho dónde donde dos durante e el él ella ellas ellos en entonces
    entre era eran es esa ese eso esos esta está están estar estas este esto estos fin fue fuera fueron ha hace hacer hacia han hasta hay incluso la las le les lo los más me menos mi mientras mismo mucho muy nada nadie ni ningún ninguna no nos nosotros nuestra
    nuestro nueva nuevo nunca o otra otras otro otros para parte pero poco podría por porque posible primero puede pueden pues que qué quién se sea sean según ser será si sí sido siempre sin sino sobre solo son su sus tal también tampoco tan tanto tener tiene tienen
    toda todas todavía todo todos tras tú tu un una unas uno unos usted va vez y ya yo | número lista cadena función método clase campo línea estado clave error resultado entrada salida carpeta directorio conexión usuario comprueba calcula contiene crea devuelve elimina guarda
    define determina permite indica actual anterior siguiente diferentes varios vacío inválido faltante disponible necesario automáticamente pedido cliente precio pantalla ventana botón equipo hora días semana año""",
    "pt": """a à ainda algo alguém algum alguma antes ao aos apenas apesar após aquela aquele aqui as às até bem cada caso com como contra cujo da daquele das de deve devem deveria dela dele depois desde dessa desse desta deste do dois dos durante e é ela elas ele eles em
    enquanto entre era eram essa essas esse esses esta está estão estar estas este estes eu faz fazer foi fora foram há isso isto já lá lhe logo mais mas me menos mesma mesmo meu minha muita muito na nada não nas nem nenhum ninguém no nos nós nossa nosso nova novo num
    numa nunca o onde os ou outra outras outro outros para parte pela pelas pelo pelos pode podem poderia por porque possível pouco primeiro próprio qual qualquer quando quanto que quem são se seja sem sempre sendo ser será seu seus só sob sobre sua suas também tanto tão
    tem têm tenha ter toda todas todo todos três tudo um uma umas uns vai você vocês | número lista cadeia função método classe campo linha estado chave erro resultado entrada saída pasta diretório conexão utilizador verifica calcula contém cria retorna remove grava define determina permite
    indica atual anterior seguinte diferentes vários vazio inválido ausente disponível necessário automaticamente pedido cliente preço ecrã tela janela botão aparelho hora dias semana ano""",
    "it": """a ad agli ai al alcune alcuni alla alle allo allora altra altre altri altro anche ancora avere aveva bene che chi ci ciò cioè come con così contro cosa cui da dagli dai dal dalla dalle degli dei del della delle dello dentro deve devono di dopo dove dovrebbe due
    durante e è ed era erano essere fa fino fra fu fuori già gli ha hai hanno i il in infatti inoltre invece io la le lei li lo loro lui ma mai me meno mentre mi mio molto ne nei nel nella nelle nessun nessuno niente noi non nostra nostro nuova nuovo o ogni oltre ora
    ossia ovvero per perché però più poco poi possibile possono potrebbe prima primo proprio può qua qualche qualcosa qualcuno quale quali quando quanto quasi quella quelle quelli quello questa queste questi questo qui se sei sempre senza si sia siamo sì solo sono sopra
    sotto sua sue sul sulla suo suoi tale tra tu tua tuo tutta tutte tutti tutto un una uno va verso via voi volta vuole | numero lista elenco stringa funzione metodo classe campo stato chiave errore risultato ingresso uscita cartella percorso connessione utente verifica calcola
    contiene crea restituisce rimuove salva imposta definisce determina permette indica corrente precedente successivo diversi vari vuoto valido mancante disponibile necessario automaticamente ordine cliente prezzo schermo finestra pulsante dispositivo ora giorni settimana anno""",
    "nl": """aan achter al alle alleen als altijd ander andere anders ben beter bij binnen blijft boven daar daarna daarom dan dat de den deze die dit doch doen doet door dus een eens eerst eerste elk elke en er erg even gaan gaat geen geeft geven gewoon goed haar had
    heb hebben heeft hem het hier hij hoe hun ieder iedereen iemand iets ik in indien is ja je jij jou jouw juist kan komen komt kon kunnen laat laatste lang langer later maakt maar maken mag man mee meer meest men met mij mijn misschien moest mogen mogelijk
    na naar naast nee net niemand niet niets nieuw nieuwe nog nooit nu of om omdat onder ons onze ook op opnieuw over per samen steeds tegen terug terwijl tijdens toch toen tot totdat tussen twee uit van vanaf vaak veel verder via volgens volgende voor vooral voordat
    vorige waar waarom waarin wanneer want waren was wat weer wel welke werd werden wie wil wilt worden wordt zal ze zeer zelf zich zij zijn zo zoals zodat zoek zonder zou zouden | aantal lijst tekenreeks functie methode klasse veld toestand sleutel fout resultaat invoer
    uitvoer map verbinding gebruiker controleert berekent bevat maakt verwijdert slaat bepaalt toont huidige verschillende meerdere lege ongeldig ontbrekende beschikbaar nodig automatisch bestelling klant prijs scherm venster knop apparaat uur dagen week jaar""",
    "pl": """a aby albo ale ani aż bardzo bez będą będzie bo by byli był była było były być cały chyba ci co coś czego czy czyli dla dlatego do dobrze dopiero dwa dwie dzięki gdy gdyby gdzie go i ich ile im inne inny iż ja jak jaka jakie jako jakoś jeden jednak jedna jego
    jej jest jestem jeszcze jeżeli już każda każde każdego każdy kiedy kilka kto która które którego której który których którzy lecz lub ma mają mamy mi między mimo może można mu musi muszą my na nad najpierw nam nas nasz natomiast nawet nie niech nich nic nigdy nim niż
    no nowa nowy o od oraz po pod podczas pomimo ponad ponieważ potem powinien powinna powinno poza prawie przed przede przez przy raz razem są się skąd sobie swój swoje ta tak taki takie tam te tego tej temu ten teraz też to trzeba tu tych tylko tym u w wam wasz we
    wie wiele więc wszyscy wszystkie wśród z za zanim zaś zawsze ze że żaden żadna | liczba liczbę lista listę łańcuch funkcja metoda klasa pole wiersz stan klucz błąd wynik wejście wyjście katalog połączenie użytkownik sprawdza oblicza zawiera tworzy usuwa zapisuje ustawia określa pozwala
    bieżący poprzedni następny różne kilka pusty nieprawidłowy brakujący dostępny wymagany automatycznie zamówienie klient cena ekran okno przycisk urządzenie godzina dni tydzień rok""",
    "tr": """acaba ama ancak artık asla aslında ayrıca az bana bazı belirli belirtilen ben benim beri bile bir birçok biraz biri birkaç bizim böyle bu buna bunlar bunu bunun burada bütün çok çünkü da daha dahil de değil diğer diye dolayı eğer en fakat fazla gibi göre
    hala hangi hatta hem henüz hep hepsi her herhangi hiç için içinde ile ilgili ilk ise işte itibaren kadar kendi kendisi ki kim kimse mı mi mu mü nasıl ne neden nedeniyle nerede o olan olarak oldu olduğu olduğunu olduğundan olmadığı olmak olması olmayan olsun olup olur ona
    onlar onu onun orada oysa öyle önce önceki pek sadece sanki şey şimdi şöyle şu sonra sonraki tarafından tüm üzerinde üzere var ve veya ya yalnız yani yapar yapılan yapmak yeniden yerine yine yok yoksa zaten zaman | sayı sayısı liste listesi dize fonksiyon işlev yöntem sınıf
    alan satır durum anahtar hata sonuç girdi çıktı klasör dizin bağlantı kullanıcı denetler hesaplar içerir oluşturur döndürür siler kaydeder ayarlar belirler gösterir geçerli sonraki farklı birden boş geçersiz eksik kullanılabilir gerekli otomatik sipariş müşteri fiyat ekran pencere düğme cihaz saat gün hafta yıl""",
    "ru": """а без более больше бы был была были было быть в вам вас весь во вот все всегда всего всех всё вы где да даже два для до другие другой его ее если есть ещё же за здесь и из или им иначе их к каждый каждая каждое как какой когда которая которого которое
    которой которые который кроме кто куда ли либо лишь между меня мне много может можно мой мы на над надо нам нас наш не него нет ни никогда никто них но новый ну о об один он она они оно от очень первый перед по под пока после поэтому почему почти при про просто раз
    разве с сам свой себя сейчас со снова сразу так также такой там тебя тем теперь то тогда того тоже только том тот три ту ты у уже хорошо хотя чего чей чем через что чтобы эта эти это этого этой этот | число количество список строка функция метод класс поле состояние ключ
    ошибка результат ввод вывод каталог соединение пользователь проверяет вычисляет содержит создаёт возвращает удаляет сохраняет задаёт определяет позволяет показывает текущий предыдущий следующий разные несколько пустой неверный отсутствует доступен необходимо автоматически заказ клиент цена экран окно кнопка устройство час дней неделя год""",
    "ja": "この その あの これ それ ここ そこ どの という ために ための による によって について に対して として から まで より だけ でも ので のに ている ていた ていない されている された される します しました しない できる できない なければならない 必要がある 場合は 場合に ときに 後に 前に 中に 上に 下に また または および そして しかし ただし なお すでに まだ 常に 次の 以下の 現在の 新しい 古い 同じ すべての それぞれの 返す 返します 取得する 設定する 表示する 作成する 削除する 追加する 更新する 計算する 確認する 読み込む 書き込む 呼び出す 渡す 指定する 利用者 文字列 数値 配列 関数 変数 処理 結果 一覧 画面 名前 時間 日付 行 列 ファイル データ サーバー エラー メッセージ パラメータ ユーザー オブジェクト",
    "zh": "的 了 是 在 和 与 或者 并且 但是 如果 那么 因为 所以 为了 这个 那个 这里 这些 那些 我们 你们 他们 可以 不能 需要 应该 必须 已经 还没有 正在 将会 之前 之后 以后 时候 当前 所有 每个 其他 相同 不同 新的 旧的 第一个 最后 下面 上面 以下 是否 用于 用来 根据 按照 关于 对于 通过 使用 返回 获取 设置 显示 创建 删除 添加 更新 计算 检查 读取 写入 调用 传递 指定 判断 用户 字符串 数字 数组 函数 变量 方法 参数 结果 列表 页面 名称 时间 日期 行 列 文件 数据 服务器 错误 消息 对象 类型 默认 情况 问题 请 不要 没有 一个 多个 进行 处理 开始 结束 支持 然后 否则",
    "ko": "이 그 저 것 수 있다 없다 한다 된다 하는 되는 있는 없는 합니다 됩니다 있습니다 없습니다 않는다 않습니다 위해 위한 대한 대해 따라 의해 통해 때문에 경우 경우에 때 후에 전에 동안 다음 이전 현재 새로운 오래된 같은 다른 모든 각 또는 그리고 그러나 하지만 만약 이미 아직 항상 다시 먼저 반환한다 반환합니다 가져온다 설정한다 표시한다 생성한다 삭제한다 추가한다 갱신한다 계산한다 확인한다 읽는다 쓴다 호출한다 전달한다 지정한다 사용자 문자열 숫자 배열 함수 변수 처리 결과 목록 화면 이름 시간 날짜 행 열 파일 데이터 서버 오류 메시지 매개변수 객체 필요하다 해야 가능하다",
}
